from pyspark.sql import functions as F

from quarry.operators import access, pages as P, facts
from quarry.plans import engine, models
from quarry.sources import readers


def test_pages_combined_and_merged(spark):
    entries = spark.createDataFrame([("d", "1", 0, " a "), ("d", "1", 1, ""), ("d", "1", 2, "b")], "doc_id string, page string, page_seq int, text string")
    assert P.combined(entries, ["doc_id", "page"]).collect()[0].text == "a\nb"
    old = spark.createDataFrame([("d", "1", "old"), ("d", "2", "kept")], "doc_id string, page string, text string")
    new = spark.createDataFrame([("d", "1", "new"), ("d", "2", " "), ("d", "3", "more")], "doc_id string, page string, text string")
    got = {r.page: (r.text, r.source) for r in P.merged_by_page(old, new).collect()}
    assert got == {"1": ("new", "recognised"), "2": ("kept", "existing"), "3": ("more", "recognised")}


def test_best_by_page(spark):
    rows = [("d", "1", "a", "short"), ("d", "1", "b", "a much longer text of the page " * 8), ("d", "1", "c", "Designation Qte")]
    df = spark.createDataFrame(rows, "doc_id string, page string, extractor string, text string")
    text = P.best_by_page(df).collect()[0].text
    assert text.startswith("a much longer") and text.endswith("Designation Qte") and "short" not in text
    assert P.candidate_score(df).collect()[0].extractor == "b"
    assert P.candidate_score(df, {"c": 100}).collect()[0].extractor == "c"


def test_scans(spark):
    rows = [("s", str(k), "a\nb\nc") for k in range(1, 10)] + [("g", str(k), "A readable sentence with many long words. " * 60) for k in range(1, 10)] + [("t", "1", "a")]
    df = spark.createDataFrame(rows, "doc_id string, page string, text string")
    got = {r.doc_id: r.scan for r in P.looks_like_scan(P.scan_metrics(df, ["objet"])).collect()}
    assert got == {"s": True, "g": False, "t": False}


def test_recognition_uses_its_cache(spark):
    wanted = spark.createDataFrame([("d", "1", bytearray(b"x")), ("d", "2", bytearray(b"y"))], "doc_id string, page string, image binary")
    read = P.recognised(wanted, None, lambda image, page: image.decode() + page + " text", "v1")
    cache = read.where("page = '1'").select("key", F.lit("from cache").alias("text"))
    got = {r.page: r.text for r in P.recognised(wanted, cache, lambda image, page: "fresh text", "v1").collect()}
    assert got == {"1": "from cache", "2": "fresh text"}
    targets = spark.createDataFrame([("d", k, "montant" if k == 9 else "x") for k in range(1, 12)], "doc_id string, page_seq int, text string")
    assert sorted(r.page_seq for r in P.target_pages(targets, ["montant"]).collect()) == [1, 2, 3, 9]


def test_caches_and_names(spark):
    schema = "filename string, content string, gaps int, pages int"
    old = spark.createDataFrame([("f", "word " * 100, 0, 3), ("g", "x", 2, 1)], schema)
    new = spark.createDataFrame([("f", "word", 0, 3), ("g", "word " * 50, 0, 2)], schema)
    assert {r.filename: r.pages for r in P.better_cache(old, new).collect()} == {"f": 3, "g": 2}
    wanted = spark.createDataFrame([("a_b.pdf",), ("Été.txt",), ("none",)], "filename string")
    cache = spark.createDataFrame([("a b.pdf",), ("ete.pdf",)], "filename string")
    assert {r.filename: r.cached for r in P.resolved_names(wanted, cache).collect()} == {"a_b.pdf": "a b.pdf", "Été.txt": "ete.pdf"}
    asked = spark.createDataFrame([("d", "12"), ("d", "page 3"), ("d", "zz")], "doc_id string, raw string")
    known = spark.createDataFrame([("d", "3"), ("d", "12")], "doc_id string, page string")
    assert {r.raw: r.page for r in P.resolved_pages(asked, known).collect()} == {"12": "12", "page 3": "3"}
    modes = spark.createDataFrame([("d", "clean"), ("d", "noisy_ocr")], "doc_id string, mode string")
    assert P.worst_mode(modes).collect()[0].mode == "noisy_ocr"


def test_organisations(spark):
    df = spark.createDataFrame([("d", 1, "1", "Cahier des charges\nBANQUE DE LA VILLE\nTel 71\nsome words"), ("d", 3, "3", "OFFICE CENTRAL")], "doc_id string, page_seq int, page string, text string")
    assert P.organisations(df, ["banque", "office"]).collect()[0].name == "BANQUE DE LA VILLE"


def test_models(spark):
    df = spark.createDataFrame([("one two", "p"), ("one two", "q"), (None, "r")], "text string, k string")
    vectors = [r.embedding for r in models.embedded(df, models.hashing_embedder).collect()]
    assert vectors[0] == vectors[1] and len(vectors[0]) == 64 and not any(vectors[2])
    scored = models.scored(df.fillna(""), lambda: lambda pairs: [float(len(b)) for _, b in pairs], "k", "text")
    assert [r.rerank for r in scored.collect()] == [7.0, 7.0, 0.0]
    answers = models.generated(df.withColumn("prompt", F.col("k")), lambda: lambda xs: ["<think>a</think>fine" if x == "p" else "Généralement" for x in xs])
    assert [r.answer for r in answers.collect()] == ["fine", None, None]
    chunks = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a")], "doc_id string, chunk_index int, text string")
    assert models.analysed(chunks, "Sum up:", lambda: lambda xs: xs).collect()[0].answer == "Sum up:\n\na\n\n---\n\nb"


def test_enrichment_refuses_what_no_page_says(spark):
    pages = spark.createDataFrame([("d", 1, "1", "Objet : Acquisition de serveurs pour le siège. Validité des offres : valable 90 jours.")], "doc_id string, page_seq int, page string, text string")
    make = models.json_stub({"validity": {"text": "valable 90 jours", "page": "1"}, "payment": {"text": "jamais dit ailleurs", "page": "1"}, "subject": {"text": "other", "page": "1"}, "zz": {"text": "x", "page": "1"}})
    stored = facts.document_facts(pages).where("field = 'subject'").select("doc_id", "field", "text", "page")
    got = {r.field: r.confidence for r in models.enriched(pages, stored, ["subject", "validity", "payment"], make).collect()}
    assert got == {"subject": "high", "validity": "medium"}


def test_index_and_answer(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.txt").write_text("Objet : Acquisition de serveurs et de licences pour le siège.\n\nLa date limite de remise est fixée au 3 mai 2024. " + "Des mots sur le paiement. " * 10)
    (folder / "b.txt").write_text("Un autre document assez long qui parle de jardins et de fleurs dans la ville.")
    me = access.Policy("u", "analyst", "A")
    assert engine.index_folder(spark, str(folder), store, me, models.hashing_embedder) == 2
    assert engine.index_folder(spark, str(folder), store, me, models.hashing_embedder) == 0
    chunks, known = spark.read.parquet(f"{store}/chunks"), spark.read.parquet(f"{store}/facts")
    ids = {r.source: r.doc_id for r in chunks.select("source", "doc_id").distinct().collect()}
    asked = spark.createDataFrame([(1, "Quelle est la date limite ?", ids["a.txt"]), (2, "jardins et fleurs", ids["b.txt"])], "query_id int, question string, doc_id string")
    hits = engine.searched(chunks, asked, me, models.hashing_embedder, k=1)
    assert {r.query_id: r.source for r in hits.collect()}[2] == "b.txt"
    got = {r.query_id: r.stage for r in engine.answered(chunks, known, asked, me, models.hashing_embedder).collect()}
    assert got == {1: "fact", 2: "passage"}
    other = access.Policy("x", "analyst", "B")
    assert engine.searched(chunks, asked, other, models.hashing_embedder).count() == 0
    cached = spark.createDataFrame([("f", 0, "1", "rien"), ("f", 1, "2", "une caution de 5000 dinars")], "filename string, page_seq int, page string, text string")
    best = engine.cached_answers(cached, "Quelle caution en dinars ?").collect()
    assert [(r.filename, r.page) for r in best] == [("f", "2")]
    assert readers.SUFFIXES[0] == ".pdf"


def test_pages_keep_arabic_signals_of_the_other_text(spark):
    old = spark.createDataFrame([("d", "1", "غرامة التأخير 5%"), ("d", "2", "غرامة التأخير")], "doc_id string, page string, text string")
    new = spark.createDataFrame([("d", "1", "نص آخر"), ("d", "2", "نص آخر")], "doc_id string, page string, text string")
    got = {r.page: r.text for r in P.merged_by_page(old, new).collect()}
    assert got == {"1": "نص آخر\nغرامة التأخير 5%", "2": "نص آخر"}
    candidates = spark.createDataFrame([("d", "1", "a", "نص " * 200), ("d", "1", "b", "غرامة التأخير 5%")], "doc_id string, page string, extractor string, text string")
    assert "5%" in P.best_by_page(candidates).collect()[0].text
