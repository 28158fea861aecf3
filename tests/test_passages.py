"""Passages and the bounded index of questions, against brute force."""

import random

import pytest

from quarry.functions.phrases import folded
from quarry.operators import chunking, passages


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "a"] * 30 + ["budget", "price", "delay"] * 6 + [f"w{k}" for k in range(60)] + ["7", "12"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    docs += [(200, "ARTICLE 1 the w1 w2. ARTICLE 2 budget price w3\n\nArticle 3 delay"), (201, "w5 w6. " * 800), (202, None), (None, "w1 w2 w3"), (203, ""), (5, docs[9][1]), (300, docs[9][1])]
    asked = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(60)] + [(70, "nothing here"), (71, ""), (72, "the budget price delay w1 w2 7 12")]
    return docs, asked


def best_by_force(docs, terms, least=2.0):
    best = {}
    own = [(k, place, set(folded(x, False).split(" "))) for k, text in docs if k is not None and text is not None for place, x in enumerate(chunking.passages_of(text))]
    for q, weights in terms.items():
        scored = [(round(sum(w for t, w in weights.items() if t in have), 4), -k, -place) for k, place, have in own]
        top = max((x for x in scored if x[0] >= least), default=None)
        if top:
            best[q] = (-top[1], -top[2], top[0])
    return best


@pytest.mark.parametrize("most", [passages.MOST_TERMS, 40])
def test_best_passages_of_many_questions(spark, most):
    from pyspark.sql import functions as F

    from quarry.functions import text as T

    docs, asked = corpus()
    questions = spark.createDataFrame(asked, "query_id long, question string")
    terms = {r["query_id"]: {t: 0.8 if t.isdigit() else 1.0 for t in r["terms"]} for r in questions.select("query_id", T.terms_of(F.col("question")).alias("terms")).collect()}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r["query_id"]: (r["doc_id"], r["place"], r["score"]) for r in passages.search_many(df, questions, most=most).collect()}
    assert found == best_by_force(docs, terms) and len(found) > 30


def test_bounds_lose_nothing_in_any_order():
    rng = random.Random(4)
    for _ in range(60):
        vocabulary = [f"t{k}" for k in range(12)]
        own = [" ".join(rng.sample(vocabulary, rng.randrange(1, 9))) for _ in range(40)]
        rows = [(q, t, rng.choice([0.8, 1.0, 0.25])) for q in range(8) for t in rng.sample(vocabulary, rng.randrange(1, 8))]
        asked, found = passages.Asked(rows, 8, 1.0), {}
        for a in range(0, 40, 7):
            asked.best(found, list(range(a, a + 7)), [0] * 7, own[a : a + 7])
        for q in range(8):
            scores = [(round(sum(w for n, t, w in rows if n == q and t in x.split(" ")), 4), -k, 0) for k, x in enumerate(own)]
            top = max(scores)
            assert found.get(q) == (top if top[0] >= 1.0 else None)


def test_no_documents_and_no_questions(spark):
    docs, asked = corpus()
    questions = spark.createDataFrame(asked, "query_id long, question string")
    assert passages.search_many(spark.createDataFrame([], "doc_id long, text string"), questions).count() == 0
    assert passages.search_many(spark.createDataFrame(docs, "doc_id long, text string"), questions.limit(0)).count() == 0
