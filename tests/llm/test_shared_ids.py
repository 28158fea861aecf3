"""Ids that are null, or that many rows share, cost no more than others."""

import random
import time

from pyspark.sql import functions as F

from quarry.llm import ngram_jaccard, toxicity


def near_copies(spark, ids):
    rng = random.Random(1)
    base, out = [f"w{rng.randrange(5000)}" for _ in range(200)], []
    for k, i in enumerate(ids):
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        out.append((i, " ".join(words)))
    return spark.createDataFrame(out, "doc_id long, text string").repartition(4)


def seconds(df):
    began = time.time()
    rows = ngram_jaccard.near_duplicates(df).groupBy("component_id", "n_shingles").count().collect()
    return time.time() - began, rows


def test_near_copies_without_ids_or_with_one(spark):
    seconds(near_copies(spark, range(50)))
    n = 1500
    usual, _ = seconds(near_copies(spark, range(n)))
    for same in (None, 7):
        took, rows = seconds(near_copies(spark, [same] * n))
        assert {r["component_id"] for r in rows} == {same} and sum(r["count"] for r in rows) == n
        assert took < 3 * usual + 10
    copies = near_copies(spark, [None] * 40)
    many = copies.crossJoin(spark.range(30)).drop("id")
    kept = ngram_jaccard.one_of_each(many).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] is None


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    again = docs.limit(100).unionByName(docs.limit(100))
    others = spark.createDataFrame([(k, f"other {k}") for k in range(6, 30)] + [(None, "none"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (5, 1), *((k, 0) for k in range(6, 30)), (29, 1), (None, 1)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs.unionByName(again).unionByName(others), labels, "toxic", {1: 50, 0: 10}, F.lit(True))
    rows = sorted((r["label"], r["text"] or "") for r in sample.collect())
    assert sum(x == 1 for x, _ in rows) == 50 and sum(x == 0 for x, _ in rows) == 10
    assert len(set(rows)) == 60 and all(t != "other 29" for _, t in rows)
    assert rows == sorted((r["label"], r["text"] or "") for r in sample.collect())
