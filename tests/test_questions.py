"""Kinds of questions, answers without a model, subjects, price rows, schemas and analyses."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.operators import access, answers, facts, questions, registry
from quarry.plans import engine
from quarry.sources import schemas


def test_kinds_of_questions(spark):
    cases = {
        "Quel est l'objet ?": {"subject"}, "De quoi parle-t-il": {"subject", "summary"}, "remise des offres": {"deadline"},
        "What does this company do, and which is it?": {"organization"}, "So what r, to me, u": {"assistant"}, "objets": set(), "": set(), None: set(),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    got = df.select("q", *[flag.alias(kind) for kind, flag in questions.kind_flags(F.col("q")).items()]).collect()
    assert {r.q: {k for k in rules.QUESTION_KINDS if r[k]} for r in got} == cases


def test_direct_and_summary_answers(spark):
    asked = spark.createDataFrame([(1, "Quel objet ?"), (2, "deadline"), (3, "overview please"), (4, "autre"), (5, None), (6, "Quel objet ?")], "query_id int, question string")
    chunks = spark.createDataFrame(
        [
            (1, 2, "Article 3 : objet du marché : l'achat de tables. Messieurs", "f", "1"), (1, 1, "Porte sur  le\nprêt de chaises", "f", None),
            (2, 1, "Date limite : ...", "f", "1"), (2, 2, None, "f", "2"), (2, 3, "REMISE DES OFFRES - lundi. 3 jours", "f", "9"),
            (3, 1, "", "f", "1"), (3, 2, "Court. La première phrase est assez longue. La PREMIERE phrase est assez longue.", "f", "2"),
            (4, 1, "Objet : rien", "f", "1"), (5, 1, "Objet : rien", "f", "1"), (6, 1, "", "f", "1"),
        ],
        "query_id int, rank int, text string, source string, page string",
    )
    got = {r.query_id: r.answer for r in questions.direct_answers(asked, chunks).collect()}
    assert got == {1: "le prêt de chaises", 2: "lundi\nSource: f, page 9."}
    assert {r.query_id: r.answer for r in questions.summary_answers(asked, chunks).collect()} == {3: "La première phrase est assez longue\nSource: f, page 2."}
    assert questions.direct_answers(asked.limit(0), chunks).count() == 0


def test_fact_summaries(spark):
    known = spark.createDataFrame([("a", "subject", " Objet. ", "2", "f"), ("a", "deadline", "lundi", "3", "f"), ("b", "deadline", "mardi", None, "f"), ("c", "payment", "x", "1", "f"), ("a", "subject", "Plus loin", "7", "f")], "doc_id string, field string, text string, page string, source string")
    assert {r.doc_id: r.answer for r in questions.fact_summaries(known).collect()}["a"] == "Objet Date limite : lundi.\nSource: f, page 2."
    assert {r.doc_id for r in questions.fact_summaries(known).collect()} == {"a", "b"}


def test_long_values_told_short(spark):
    long = "La garantie est de 12 mois, puis de Trois ans, soit douze (12) mois et 12  MOIS. " + "x" * 260
    df = spark.createDataFrame([("guarantee", long), ("guarantee", "garantie 2 ans"), ("reception", "réception provisoire " + "x" * 400), ("payment", long), ("guarantee", None)], "field string, value string")
    got = [r.v for r in df.select(questions.short_value(F.col("field"), F.col("value")).alias("v")).collect()]
    assert got == ["Garantie: 12 mois; Trois ans; douze (12) mois.", "garantie 2 ans", "réception provisoire " + "x" * 400, long, None]


def test_subject_score(spark):
    rows = [("Le marché a pour objet l'achat de 3 tables et de chaises", "1", 0), ("Objet court", "2 bis", None), ("Objet court", "12", 3), (None, None, None), ("ARTICLE 1 article 2 ARTICLE 3 sommaire d'un texte", "x", 20)]
    df = spark.createDataFrame(rows, "text string, page string, pattern int")
    got = [tuple(r.s) for r in df.select(facts.subject_score(F.col("text"), F.col("page"), F.col("pattern")).alias("s")).collect()]
    assert got == [(150, 20, 56, -1), (20, 0, 11, -2), (-40, 17, 11, -12), (-40, 0, 0, -999), (-530, 0, 49, -999)]


def test_fact_text_and_pricing_items(spark):
    df = spark.createDataFrame([("Livraison\x07 rapide. Date limite le 3",), ("La caution de 5 % CAUTION définitive",), ("Prix ferme caution de 5 %",), ("Selon lot 3 et suite",)], "t string")
    assert [r.v for r in df.select(facts.fact_text(F.col("t")).alias("v")).collect()] == ["Livraison rapide", "La caution de 5 % CAUTION définitive", "Prix ferme", "Selon"]
    pages = spark.createDataFrame([("d", 1, "1", "1 Chaises Unité 4 sans bordereau"), ("d", 2, "2", "Prix unitaire 1 Chaises  pliantes Unite 4 2 Tables Unité 1,5"), ("d", 3, "3", "Prix unitaire 1 CHAISES pliantes unité 4"), ("e", 1, "1", None)], "doc_id string, page_seq int, page string, text string")
    got = sorted((r.label, r.value, r.page) for r in facts.pricing_items(pages).collect())
    assert got == [("Bordereau item 1", "Chaises pliantes - Unite 4", "2"), ("Bordereau item 2", "Tables - Unite 1,5", "2")]


def test_tables_open_before_they_are_written_and_with_missing_columns(spark, tmp_path):
    assert schemas.opened(spark, str(tmp_path), "documents").count() == 0
    spark.createDataFrame([("1", "f")], "id string, filename string").write.parquet(f"{tmp_path}/documents")
    row = schemas.opened(spark, str(tmp_path), "documents").collect()[0]
    assert row.filename == "f" and row.status is None and len(row) == len(schemas.SCHEMAS["documents"].split(", "))


def test_health(spark):
    assert tuple(registry.health(spark.range(3)).collect()[0]) == ("healthy", "connected", "connected", "connected", "local", 3)
    assert registry.health(None, embeddings="connected").collect()[0].status == "degraded"
    assert registry.health(spark.range(1), llm=False).collect()[0].status == "degraded"


def test_analyses_and_their_audit(spark):
    me = access.Policy("u", "analyst", "A")
    docs = spark.createDataFrame([("1", "f", "A", "u", "department"), ("2", "g", "B", "v", "department"), ("3", "h", "A", "u", "private")], "id string, filename string, department_id string, uploaded_by string, visibility string")
    known = spark.createDataFrame([("1", "payment", "à 30 jours"), ("2", "payment", "x")], "doc_id string, field string, text string")
    made, audit = engine.analysed_documents(docs, known, me, "tender_checklist", F.current_timestamp())
    lines = made.collect()[0].answer.split("\n")
    assert made.count() == 1 and len(lines) == 21 and lines[20] == "21. Quelles sont les modalites de paiement ?: à 30 jours" and lines[0].endswith(answers.NOT_FOUND["fr"])
    assert [(r.user_id, r.resource) for r in audit.collect()] == [("u", "f")]
    chunks = spark.createDataFrame([("1", 0, "un"), ("3", 0, "trois"), ("2", 0, "deux")], "doc_id string, chunk_index int, text string")
    made, audit = engine.analysed_documents(docs, known, me, "summary", F.current_timestamp(), chunks, "Sum up:", lambda: lambda xs: xs)
    assert {r.doc_id for r in made.collect()} == {"1", "3"} and audit.count() == 2
    with pytest.raises(ValueError):
        engine.analysed_documents(docs, known, me, "summary", F.current_timestamp())


def test_checklist_with_flags(spark):
    from quarry.operators import answers

    facts = spark.createDataFrame([
        ("d", "variants", "Les variantes ne sont pas admises"), ("e", "variants", "Les variantes sont admises"), ("d", "cnss", "Attestation CNSS"),
        ("d", "deadline", "3 mai 2024"), ("d", "deadline", "4 mai 2024"), ("d", "rne", None), ("d", "fiscal_certificate", " - "), ("other", "cnss", "x"),
    ], "doc_id string, field string, text string")
    docs = spark.createDataFrame([("d",), ("e",), ("none",), ("d",)], "doc_id string")
    rows = {(r["doc_id"], r["field"]): r["answer"] for r in answers.flagged_checklist(facts, docs).collect()}
    missing = answers.NOT_FOUND["fr"]
    assert len(rows) == 63 and answers.flagged_checklist(facts, docs).count() == 63
    assert rows["d", "variants"] == "Non - Les variantes ne sont pas admises" and rows["e", "variants"] == "Oui / a verifier - Les variantes sont admises"
    assert rows["d", "cnss"] == "Oui - Attestation CNSS" and rows["d", "deadline"] == "3 mai 2024"
    assert rows["d", "rne"] == rows["d", "fiscal_certificate"] == missing
    assert {a for (d, _), a in rows.items() if d == "none"} == {missing}
