"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from quarry.plans import registry
from quarry.session import local_session

HEADLINE = (
    "topk_cosine multi_query_topk multiprobe_dedupe focus_bonus section_detect char_ratios fold_text chunk_documents exact_dedupe "
    "visible_documents reconcile page_gaps passage_search best_passages question_passages conversation_text best_fact tumbling_windows "
    "session_windows mined_facts answer_cascade"
).split()


def seconds(spark, sf_dir: str, name: str) -> float:
    """Wall-clock time of a query, all of its rows computed and none collected."""
    began = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    seconds(spark, sf_dir, "exact_dedupe")  # code generation and Python's start are not what is measured
    seconds(spark, sf_dir, "topk_cosine")
    seconds(spark, sf_dir, "multi_query_topk")
    took = {name: seconds(spark, sf_dir, name) for name in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
