"""What is read out of pages takes no more work than they need, and finds the same."""

import random
import re
import time

from pyspark.sql import functions as F

from quarry.operators import facts, listings, nearby, requested
from quarry.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def expected_date(text: str, most: int) -> str | None:
    python = lambda p: re.compile(p.replace("(?iU)", "(?i)"))
    for a in python(nearby.ANCHOR).finditer(text):
        for p in (nearby.LONG_DATE, nearby.SHORT_DATE):
            v = python(p).search(text, a.start())
            if v and v.end() <= a.start() + most:
                return v[0]
    return None


def test_deadlines_without_joins_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["date limite", "remise des offres", "au plus tard", "le 3 mai 2024 à 10 h", "1/2/2024", "2024-03-05", "111/02/2024", "mot", "x" * 17, "12"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) + " fin" for _ in range(150)]
    df = spark.createDataFrame([(k, 1, "1", t) for k, t in enumerate(texts)], "doc_id long, page_seq long, page string, text string")
    for most in (20, 40, 520):
        found = {r["doc_id"]: r["text"] for r in nearby.deadlines(df, most).collect()}
        assert found == {k: x for k, t in enumerate(texts) if (x := expected_date(t, most))}
    assert "Join" not in plan_of(nearby.deadlines(df))


def test_a_small_table_is_dealt_before_texts_are_made_of_it(spark, sf_dir):
    for name in ("pricing_items", "promoted_facts"):
        assert "Repartition" in plan_of(registry.QUERIES[name](spark, sf_dir))
    for name in ("near_deadlines", "arabic_tables", "promoted_facts"):
        assert "RepartitionByExpression" in plan_of(registry.QUERIES[name](spark, sf_dir))


def test_rows_of_a_table_are_read_once_for_all_fields(spark):
    df = spark.createDataFrame([(1, 1, "1", "الوثائق المكونة للعرض\n| 1 | جدول الأثمان رقم 5 |\n| 2 | جدول الأثمان رقم 6 |")], "doc_id long, page_seq long, page string, text string")
    rules = [r for r in listings.LISTINGS if r.way == "table"]
    found = listings.listings(df, rules)
    assert [(r["field"], [x["text"] for x in r["items"]]) for r in found.collect()] == [("financial_documents", ["جدول الأثمان رقم 5", "جدول الأثمان رقم 6"])]
    reads = lambda of: plan_of(listings.listings(df, of)).count("split(")
    assert reads(rules) <= reads(rules[:1]) + 2


def test_items_are_judged_once_for_all_fields(spark):
    texts = ["Autorisation du constructeur HPE", "Caution provisoire de 500 dinars", "références similaires : certificats", "", None, "ARTICLE 3", "autre"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    fields = ["caution", "manufacturer_authorization", "references", "validity"]
    for r in df.select("text", facts.reliable_fields(F.col("text"), fields).alias("all"), *[facts.reliable(F.lit(f), F.col("text")).alias(f) for f in fields]).collect():
        assert r["all"] == [f for f in fields if r[f]]


def test_pages_without_units_are_left_before_rows_are_tried(spark):
    page = "Quantité Désignation " + " ".join(f"{k % 90 + 1} Abcd efgh ijkl" for k in range(400))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_seq"), F.lit("1").alias("page"), F.concat(F.lit(page), F.col("id").cast("string")).alias("text"))
    requested.mined_items(df.limit(1)).collect()
    began = time.perf_counter()
    assert requested.mined_items(df).count() == 0
    assert time.perf_counter() - began < 10
    torn = spark.createDataFrame([(1, 1, "1", "Désignation Quantité\n1 Papier fin\nlot\n5")], "doc_id long, page_seq long, page string, text string")
    assert [(r["label"], r["value"]) for r in requested.mined_items(torn).collect()] == [("Papier fin", "5 lot")]
