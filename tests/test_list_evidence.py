"""Lists as evidence of facts."""

from quarry.operators import list_evidence as E

LISTS = "doc_id long, field string, items array<struct<text:string,page:string>>, source string"


def lists(spark, *rows):
    return spark.createDataFrame([(d, f, None if items is None else [(t, "7") for t in items], s) for d, f, items, s in rows], LISTS)


def test_merged(spark):
    tech, admin = "technical_documents", "administrative_documents"
    strong, longer = ["Documentation technique", "Fiche produit"], ["x", "y", "z"]
    current = lists(
        spark, (1, tech, strong, "a"), (2, tech, strong, "a"), (3, tech, ["x", "y"], "a"), (4, tech, ["x", "y"], E.PROTECTED), (5, tech, strong, "a"), (6, tech, [], "a"),
        (8, admin, ["registre", "cnss"], "a"), (9, admin, ["registre", "cnss", "بطاقة"], "a"), (10, tech, strong, "a"), (10, tech, strong, "a"),
    )
    candidate = lists(
        spark, (1, tech, longer, "b"), (2, tech, ["x", "y"], "b"), (3, tech, ["x"], "b"), (4, tech, longer, "b"), (5, tech, None, "b"), (6, tech, None, "b"), (7, tech, ["x"], "b"),
        (8, admin, ["x"], "b"), (9, admin, ["x", "y"], "b"),
    )
    got = {r["doc_id"]: r["source"] for r in E.merged(current, candidate).collect()}
    assert got == {1: "b", 2: "a", 3: "b", 4: E.PROTECTED, 5: "a", 6: "a", 7: "b", 8: "b", 9: "a", 10: "a"}


def test_united_keeps_the_order(spark):
    a, b = lists(spark, (1, "f", ["Le devis signé", "Fiche B", "fiche b"], "a")), lists(spark, (1, "f", ["Autre", "devis signe", None, "Fiche C"], "b"), (2, "f", ["Seul"], "b"))
    got = {r["doc_id"]: [x["text"] for x in r["items"]] for r in E.united(a, b).collect()}
    assert got == {1: ["Le devis signé", "Fiche B", "Autre", "Fiche C"], 2: ["Seul"]}


def test_promoted(spark):
    tech, admin = E.SOURCES
    own = lists(
        spark, (1, admin, ["- Caution provisoire de 100 dinars"], "a"), (1, tech, ["rien", "2) Caution provisoire de 500 dinars", "Caution provisoire de 700 dinars"], "a"),
        (2, admin, [None, "", "Garantie du constructeur", "Attestation du fabricant habilité"], "a"), (3, "financial_documents", ["Caution provisoire de 5 dinars"], "a"), (4, tech, None, "a"),
    )
    facts = spark.createDataFrame([(2, "caution", "x"), (1, "references", "projets similaires")], "doc_id long, field string, text string")
    got = sorted(tuple(r) for r in E.promoted(own, facts).collect())
    assert got == [(1, "caution", "Caution provisoire de 500 dinars", "7", tech), (2, "manufacturer_authorization", "Attestation du fabricant habilité", "7", admin)]
    have = spark.createDataFrame([(1, "caution", "Caution provisoire de 9 dinars")], "doc_id long, field string, text string")
    assert {r["doc_id"] for r in E.promoted(own, have).collect()} == {2}
    assert E.promoted(own.limit(0), facts).count() == 0
