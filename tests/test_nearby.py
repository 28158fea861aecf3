"""Values near anchors, against brute force on positions."""

import random
import re

from pyspark.sql import functions as F

from quarry.operators import nearby


def test_next_values_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "12", "x ", "7", "é", "\n", ""]) for _ in range(rng.randrange(40))) for _ in range(120)] + ["", "ab", "ab1", None, "1ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    for most in (3, 6, 1000):
        anchors, values = nearby.matches(df, ["k"], "t", "ab"), nearby.matches(df, ["k"], "t", "[0-9]+")
        found = sorted((r["k"], r["at"], r["value"]) for r in nearby.next_values(anchors, values, ["k"], most).collect())
        expected = []
        for k, t in enumerate(texts):
            for a in re.finditer("ab", t or ""):
                v = re.compile("[0-9]+").search(t, a.start())
                expected.append((k, a.start(), v[0] if v and v.end() <= a.start() + most else None))
        assert found == sorted(expected)


def told(spark, *texts):
    df = spark.createDataFrame([(1, k, str(k), t) for k, t in enumerate(texts, 1)], "doc_id long, page_seq long, page string, text string")
    return [(r["text"], r["page"]) for r in nearby.deadlines(df).collect()]


def test_deadlines(spark):
    assert told(spark, "rien", "La date limite est le 01/02/2024. Puis le 3 mai 2024 à 10 h.") == [("3 mai 2024 à 10 h", "2")]
    assert told(spark, "Date limite " + "mot " * 140 + "01/02/2024", "au plus tard le 2024-03-05") == [("2024-03-05", "2")]
    assert told(spark, "La remise des offres : " + "a" * 496 + " 1/2/2024") == []
    assert told(spark, "au plus tard le 1/2/2024 pour toute demande d'éclaircissement. La réception des offres a lieu le 5/2/2024") == [("5/2/2024", "1")]
    assert told(spark, "La date limite est le 9/9/2023. Dernier délai de réception des offres : 12/03/2024 - 10h00") == [("12/03/2024 - 10h00", "1")]
    assert told(spark, "le 12/03/2024 à 10h TUNEPS sera fermée automatiquement") == [("12/03/2024 à 10h", "1")]
    assert told(spark, "آخر أجل لقبول العروض يوم 2024/05/06") == [("2024/05/06", "1")]
    assert told(spark, None, "", "date limite") == []
    assert nearby.deadlines(spark.createDataFrame([], "doc_id long, page_seq long, page string, text string")).count() == 0
    assert nearby.matches(spark.range(1).select("id", F.lit("aXbX").alias("t")), ["id"], "t", "X").count() == 2
