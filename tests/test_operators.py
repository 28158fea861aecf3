import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import access, answers, chunking, facts, passages, reports, retrieval, tables


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).collect()[0][0]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# chunking -------------------------------------------------------------------


def test_split_large(spark):
    split = chunking.split_large(F.col("t"))
    assert one(spark, split, " short \n") == ["short"]
    assert [len(x) for x in one(spark, split, "x" * 2500)] == [1200, 1200, 100]
    # 300 paragraphs of one letter: 400 letters and 399 separators of two fill 1198 of 1200
    pieces = one(spark, split, "p\n\n" * 900)
    assert [len(x) for x in pieces] == [1198, 1198, 298]
    # sentences are joined by an empty line
    pieces = one(spark, split, "aaaa. " * 400)
    assert all(len(x) <= 1200 for x in pieces) and "\n\n".join(pieces) == "\n\n".join(["aaaa."] * 400)
    # a paragraph that is too long is sliced, and what was open before it is closed
    pieces = one(spark, split, "head\n\n" + "y" * 3000 + "\n\nend")
    assert [len(x) for x in pieces] == [4, 1200, 1200, 600, 3]


def test_merge(spark):
    def merged(*sizes, pages=None):
        entries = [(p, "x" * n) for p, n in zip(pages or "1" * len(sizes), sizes)]
        df = spark.createDataFrame([(entries,)], "e array<struct<page:string,text:string>>")
        return [len(r.text) for r in df.select(chunking.merged(F.col("e"))).collect()[0][0]]

    assert merged(100, 100) == [201]
    assert merged(200, 200) == [200, 200]
    assert merged(100, 100, pages="12") == [100, 100]
    assert merged(1100, 150) == [1100, 150]
    assert merged(100, 50, 900, 100) == [1153]
    assert merged() == []


def test_chunks(spark):
    entries = [("d", 0, "1", "- Page 1 -"), ("d", 1, "1", "a useful sentence of enough characters to be kept here."), ("d", 2, "2", "x" * 2500), ("e", 0, "1", "tiny")]
    out = chunking.chunks(spark.createDataFrame(entries, "doc_id string, page_seq int, page string, text string"))
    got = [(r.id, r.page, len(r.text)) for r in out.orderBy("doc_id", "chunk_index").collect()]
    assert [x[0] for x in got] == ["d_c0", "d_c1", "d_c2", "d_c3"] and [x[1] for x in got] == ["1", "2", "2", "2"]


def test_embedded_pages(spark):
    cut = chunking.embedded_pages(F.col("t"), F.lit("7"))
    assert [tuple(x) for x in one(spark, cut, "before\n- Page 2 -\nP 2 two\nPage 3\nthree")] == [("7", "before"), ("2", "two"), ("3", "three")]
    assert [tuple(x) for x in one(spark, cut, "plain")] == [("7", "plain")]


def test_page_gaps(spark):
    df = spark.createDataFrame([("d", 2, 7), ("d", 5, 7), ("e", 1, 0)], "k string, p int, n int")
    assert rows(chunking.page_gaps(df, "k", "p", "n")) == [("d", "1,3-4,6-7", 5), ("e", "", 0)]


def test_quality_metadata(spark):
    df = spark.createDataFrame([("d", 1, "good words"), ("d", 3, "more words"), ("e", 1, "?!?! a"), ("f", 1, "clean text")], "k string, n int, text string")
    assert {r.k: r.mode for r in chunking.quality_metadata(df, "k", "n", "n").collect()} == {"d": "partial_pages", "e": "noisy_ocr", "f": "clean"}


def test_articles_items_and_offsets(spark):
    assert one(spark, chunking.articles(F.col("t")), "intro ARTICLE 1 one Article 2 two") == ["intro", "ARTICLE 1 one", "Article 2 two"]
    assert one(spark, chunking.listed_items(F.col("t")), "\n1. first\n2) second\n- first\n") == ["first", "second"]
    df = spark.createDataFrame([("d", 1, "abc"), ("d", 2, "de")], "k string, n int, text string")
    assert [(r.start, r.end) for r in chunking.offsets(df, "k", "n").orderBy("n").collect()] == [(0, 3), (5, 7)]


# access -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def registry(spark):
    data = [
        ("1", "department", "A", "x", None, "indexed", "h1"), ("2", "department", "B", "x", None, "indexed", "h2"), ("3", "private", "B", "me", None, "indexed", "h3"),
        ("4", "private", "A", "x", "u", "indexed", "h4"), ("5", "restricted", "A", "x", None, "queued", "h1"),
    ]
    df = spark.createDataFrame(data, "id string, visibility string, department_id string, uploaded_by string, universe_id string, status string, file_hash string")
    return df.withColumns({"filename": F.lit("f.pdf"), "created_at": F.timestamp_seconds(F.col("id").cast("long"))})


def test_access_rules_differ(registry):
    me = access.Policy("me", "viewer", "A")
    ids = lambda where: [r.id for r in registry.where(where).orderBy("id").collect()]
    assert ids(access.registry_filter(me)) == ["1", "3"]
    assert ids(access.can_view(me)) == ["1", "3", "5"]
    assert ids(access.facts_filter(access.Policy("me", "viewer", "A", isolated=False))) == ["3"]
    assert ids(access.registry_filter(None)) == ids(access.registry_filter(access.Policy("r", "admin"))) == list("12345")
    chunks = registry.withColumnRenamed("department_id", "department").withColumn("section", F.lit("s"))
    seen = chunks.where(access.search_filter(departments=None, user_id="me", is_admin=False))
    assert sorted(r.id for r in seen.collect()) == ["1", "2", "3"]
    assert chunks.where(access.search_filter(departments=["A"], is_admin=False)).count() == 1
    assert access.latest_by_source(registry, me).collect()[0].id == "3"
    assert rows(access.visible_duplicates(registry.where("status = 'queued'"), registry.where("status = 'indexed'"), me).select("id")) == [("5",)]
    assert [r.id for r in access.visible(registry, me).collect()] == ["3", "1"]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "y")], "k int, v string, w string")
    assert sorted(map(tuple, tables.upsert(t, new, "k").select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.insert_if_absent(t, new, "k").select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(tables.update(t, new, "k").collect(), key=lambda r: r.k)[1] == (2, "c", "x")
    assert [r.k for r in tables.delete(t, new, "k").collect()] == [1]
    assert [r.k for r in tables.page(t, 2, 1, "k").collect()] == [2]
    uploads = spark.createDataFrame([("1", "f", "a" * 64), ("2", "f", "b" * 64), ("3", "f", "b" * 64)], "id string, filename string, file_hash string")
    assert sorted(r.stored_name for r in tables.unique_names(uploads).collect()) == ["bbbbbbbb_2_f", "bbbbbbbb_f", "f"]


# retrieval ---------------------------------------------------------------------


def test_retrieval(spark):
    items = spark.createDataFrame([(k, [float(k), 1.0], k % 2) for k in range(40)] + [(99, [0.0, 0.0], 0)], "vec_id int, embedding array<float>, label int").repartition(5)
    hits = retrieval.top_k(items, [1.0, 0.0], 3).collect()
    assert [r.vec_id for r in hits] == [39, 38, 37]
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query array<float>")
    many = retrieval.top_k_many(items, queries, 2)
    assert rows(many.select("query_id", "rank", "vec_id")) == [(1, 1, 39), (1, 2, 38), (2, 1, 0), (2, 2, 1)]
    probes = [(F.col("label") == 0, 2), (None, 3)]
    found = {r.vec_id: r.probe for r in retrieval.multi_probe(items, [1.0, 0.0], probes).collect()}
    assert found == {38: 0, 36: 0, 39: 1, 37: 1}
    assert retrieval.probes_for(["a", "b", "c"], False) == [("a", 10), ("b", 10), (None, 25)]
    assert retrieval.probes_for(["a"], True) == [("a", 4), (None, 8)]


def test_rerank_falls_back_on_the_score(spark):
    hits = spark.createDataFrame([("q", 1, 0.001, 0.0, 0.9), ("q", 2, 0.002, 0.0, 0.5), ("r", 1, 0.2, 0.0, 0.9), ("r", 2, 0.5, 0.0, 0.5)], "q string, vec_id int, rerank double, bonus double, score double")
    out = {(r.q, r["rank"]): r.vec_id for r in retrieval.reranked(hits, 2, False, ["q"], ["vec_id"]).collect()}
    assert out == {("q", 1): 1, ("q", 2): 2, ("r", 1): 2, ("r", 2): 1}


# reports ------------------------------------------------------------------------


def test_reconciliation(spark):
    docs = spark.createDataFrame([("a", "queued", 0), ("b", "indexed", 2), ("c", "indexed", 3), ("d", "indexed", 1)], "id string, status string, chunk_count int")
    chunks = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",)] + [("z",)] + [(None,)], "doc_id string")
    state = {r.id: r.state for r in reports.reconciliation(docs, chunks).collect()}
    assert state == {"a": "status_mismatch", "b": "ok", "c": "count_mismatch", "d": "missing", "z": "orphan"}
    assert rows(reports.repairs(docs, chunks)) == [("a", "indexed", 7), ("c", "indexed", 1)]
    assert ("d", "failed", 0) in rows(reports.repairs(docs, chunks, missing_failed=True))


def test_quotes(spark):
    df = spark.createDataFrame([("one two three", "x One Two Three"), ("a b c d e f g h i", "a b c d e zz"), ("q", "r")], "q string, p string")
    assert [tuple(r[0]) for r in df.select(reports.quote_check(F.col("q"), F.col("p"))).collect()] == [("exact", 1.0), ("approximate", 0.556), ("missing", 0.0)]


def test_evaluation_and_markers(spark):
    golden = spark.createDataFrame([("d", "a", "x", 1), ("d", "b", "y", 1), ("d", "c", "z", 1)], "doc_id string, field string, expected string, least int")
    found = spark.createDataFrame([("d", "a", "has X"), ("d", "b", "no")], "doc_id string, field string, text string")
    assert rows(reports.evaluated(golden, found)) == [("d", 1, 1, 1, True)]
    pages, markers = spark.createDataFrame([(1, "Alpha beta")], "page int, text string"), spark.createDataFrame([(1, "f", "alpha"), (1, "g", "no"), (2, "f", "x")], "page int, field string, marker string")
    assert rows(reports.marker_score(pages, markers)) == [(1, 1, 2), (2, 0, 1)]


# facts, passages, answers -----------------------------------------------------------

PAGES = [
    ("d", 1, "1", "Objet : Acquisition de serveurs et de licences pour le siège.\n\nLOT 1 : Serveurs\nLOT 2 : Licences"),
    ("d", 2, "2", "La date limite de remise des offres est fixée au 3 mai 2024. Le cautionnement provisoire est de 5000 dinars. Pénalités de retard : 1 pour mille par jour."),
    ("d", 3, "3", "Documents administratifs :\n1. Attestation fiscale\n2. Extrait du registre\nDocuments techniques :\n- Fiche technique\nIM(3) : valeur"),
    ("e", 1, "1", "Rien."),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, page_seq int, page string, text string")


def test_facts(pages):
    got = {r.field: (r.text, r.page) for r in facts.document_facts(pages).collect()}
    assert got["subject"] == ("Acquisition de serveurs et de licences pour le siège", "1")
    assert got["deadline"] == ("3 mai 2024", "2") and "5000 dinars" in got["caution"][0] and "penalties" in got
    lists = {r.field: r["items"] for r in facts.list_facts(pages).collect()}
    assert lists["administrative_documents"] == ["Attestation fiscale", "Extrait du registre"]
    assert [(r.type, r.label, r.value) for r in facts.mined_facts(pages).where("type = 'lot'").orderBy("label").collect()] == [("lot", "1", "Serveurs"), ("lot", "2", "Licences")]
    assert rows(facts.placeholders(pages)) == [("d", "IM3", "valeur")]
    assert facts.profile(facts.document_facts(pages)).collect()[0].core_present == 4


def test_reliability(spark):
    df = spark.createDataFrame([("deadline", "sans date"), ("deadline", "le 01/02/2024"), ("caution", "restitution de la caution de 5 %"), ("guarantee", "garantie de 12 mois"), ("subject", "Article 3 Objet")], "f string, t string")
    assert [r[0] for r in df.select(facts.reliable(F.col("f"), F.col("t"))).collect()] == [False, True, False, True, False]


def test_evidence(pages):
    found = facts.evidence_pages(pages.withColumns({"heading": F.lit(""), "section": F.lit("")}), ["caution", "pénalité"], most=2)
    assert [(r.doc_id, r.page_seq) for r in found.orderBy("doc_id", "rank").collect()] == [("d", 2), ("d", 1), ("e", 1)]


def test_preferred(spark):
    a = spark.createDataFrame([("d", "x", "long enough", "low"), ("d", "y", "same", "high")], "doc_id string, field string, text string, confidence string")
    b = spark.createDataFrame([("d", "x", "sure", "high"), ("d", "y", "also", "high")], "doc_id string, field string, text string, confidence string")
    assert {r.field: r.text for r in facts.preferred(a, b).collect()} == {"x": "sure", "y": "same"}


def test_passages(spark, pages):
    docs = spark.createDataFrame([(1, "intro ARTICLE 3 caution de 5000 dinars ARTICLE 4 autre"), (2, "rien")], "doc_id int, text string")
    best = passages.search(docs, ["caution", "dinars"], "3").collect()
    assert [(r.doc_id, r.score, r.passage) for r in best] == [(1, 10.0, "ARTICLE 3 caution de 5000 dinars")]
    asked = spark.createDataFrame([(7, "caution dinars"), (8, "nothing here")], "query_id int, question string")
    assert [(r.query_id, r.doc_id, r.place) for r in passages.search_many(docs, asked).collect()] == [(7, 1, 1)]
    assert rows(passages.grep(docs, ["CAUTION"]).select("doc_id", "number")) == [(1, 1)]


def test_answers(spark, pages):
    asked = spark.createDataFrame([(1, "Quelle est la date limite ?", "d"), (2, "What is the warranty?", "d"), (3, "Who are you?", "d"), (4, "Quel objet ?", "e")], "query_id int, question string, doc_id string")
    found = spark.createDataFrame([(4, "un passage"), (2, "généralement un an")], "query_id int, passage string")
    got = {r.query_id: (r.stage, r.answer) for r in answers.answered(asked, facts.document_facts(pages), found).collect()}
    assert got[1] == ("fact", "3 mai 2024 (page 2)") and got[3] == ("identity", answers.WHO["en"])
    assert got[4] == ("passage", "un passage") and got[2] == ("missing", answers.NOT_FOUND["en"])
    strict = {r.query_id: r.stage for r in answers.answered(asked, facts.document_facts(pages), found, strict=True).collect()}
    assert strict[4] == "missing"
    text = answers.checklist(facts.document_facts(pages), spark.createDataFrame([("d",)], "doc_id string")).collect()[0].checklist
    assert text.split("\n")[0].startswith("1. Subject: Acquisition") and len(text.split("\n")) == len(facts.CORE_FIELDS)


def test_uuid5_is_the_standard_one(spark):
    for name in ("file.pdf_c0", "é", ""):
        assert one(spark, T.uuid5(F.col("t")), name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_three_way(spark):
    fact = lambda *r: spark.createDataFrame(list(r), "doc_id string, field string, text string")
    expected = spark.createDataFrame(
        [("d", "a", "present", ["x"]), ("d", "b", "present", ["x"]), ("d", "c", "not_found", []), ("d", "e", None, []), ("d", "f", None, [])],
        "doc_id string, field string, status string, contains array<string>",
    )
    got = reports.three_way(fact(("d", "a", "has X"), ("d", "c", "made up"), ("d", "e", "z")), fact(("d", "a", "x"), ("d", "b", "x")), expected)
    assert {r.field: r.winner for r in got.collect()} == {"a": "both", "b": "other", "c": "other", "e": "needs_review", "f": "unknown"}


def test_payload_search_and_sources(spark):
    chunks = spark.createDataFrame([("d", "File.PDF", "2", 1), ("d", "File.PDF", "1", 0), ("e", "other", "1", 0), (None, "file", "1", 0)], "doc_id string, source string, page string, chunk_index int")
    assert rows(reports.found_documents(chunks, "file", ["source"])) == [("d", 2, "1")]
    named = spark.createDataFrame([("Alpha", None), ("b", "has ALPHA"), ("c", "d")], "name string, description string")
    assert reports.named_like(named, "alpha").count() == 2
    listed = spark.createDataFrame([("d", "f", [("1", None), ("1", None), ("2", "s")])], "doc_id string, field string, items array<struct<page:string,section:string>>")
    assert [tuple(x) for x in reports.fact_sources(listed).collect()[0].places] == [("1", "general"), ("2", "s")]


def test_placeholders_are_replaced(spark):
    found = spark.createDataFrame([("d", "f", "see IM(3) and IM 4"), ("d", "g", "plain")], "doc_id string, field string, text string")
    values = spark.createDataFrame([("d", "IM3", r"5 $ \ x")], "doc_id string, key string, value string")
    assert {r.field: r.text for r in facts.resolved(found, values).collect()} == {"f": r"see 5 $ \ x and IM4", "g": "plain"}


def test_mined_scores(spark):
    mined = spark.createDataFrame([("d", "lot", "Serveurs rack", "prix unitaire"), ("d", "metric", "zz", "5")], "doc_id string, type string, label string, value string")
    asked = spark.createDataFrame([(1, "d", "Quel lot de serveurs ?")], "query_id int, doc_id string, question string")
    assert [(r.label, r.score, r["rank"]) for r in facts.mined_scores(mined, asked).collect()] == [("Serveurs rack", 5, 1)]


def test_whole_columns_are_packed_and_merged_like_expressions(spark):
    """The linear forms against the expressions, which stay the definition inside lambdas."""
    import random

    rng = random.Random(3)
    rows = [([("x" * rng.randrange(1, 40)) for _ in range(rng.randrange(12))], [str(rng.randrange(3)) for _ in range(12)]) for _ in range(60)]
    df = spark.createDataFrame([(b, p[: len(b)]) for b, p in rows], "b array<string>, p array<string>")
    got = df.select(chunking.packed(F.col("b"), 30).alias("x"), chunking._packing(30)(F.col("b"), F.lit(True)).alias("y")).collect()
    assert all(r.x == r.y for r in got)
    entries = F.zip_with("p", "b", lambda p, b: F.struct(p.alias("page"), b.alias("text")))
    both = df.select(chunking.merged(entries, 20, 60).alias("x"), chunking._merging(20, 60)(F.col("p"), F.col("b")).alias("y")).collect()
    assert all([(e.page, e.text) for e in r.x] == list(zip(r.y.pages, r.y.texts)) for r in both)


def test_a_very_long_document_is_chunked_in_linear_time(spark):
    import time

    text = "\n\n".join(f"Paragraph {k} with a few words in it, and no more than that." for k in range(40_000))
    df = spark.createDataFrame([("d", 0, "1", text)], "doc_id string, page_seq int, page string, text string")
    began = time.perf_counter()
    assert chunking.chunks(df).count() > 1000
    assert time.perf_counter() - began < 20
