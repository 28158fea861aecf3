"""Articles and offsets over page breaks, against brute force on the joined text."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import articles

MARK = re.compile(r"\bARTICLE\s*\d+\b", re.IGNORECASE)


def paged(seed=1):
    rng = random.Random(seed)
    parts = ["ARTICLE 1 : Objet", "article\n2", "Le délai", "ARTICLE12 fin", "ARTICLE", "7 suit", "mot", "", " \t", "xARTICLE 3", "ARTICLE 4x", "é è", "ARTICLE 99"]
    docs = {}
    for d in range(40):
        docs[d] = [(k, None if rng.random() < 0.05 else rng.choice([" ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(6)))) for k in range(rng.randrange(1, 7))]
    docs[40] = [(1, "ARTICLE 1 " + "long " * 5000), (2, "go on " * 3000), (3, "ARTICLE 2 end")]
    return docs


def joined_of(pages):
    text, spans = "", []
    for seq, own in pages:
        if spans:
            text += "\n\n"
        spans.append((len(text), seq))
        text += own or ""
    return text, spans


def page_of(spans, at):
    return [seq for start, seq in spans if start <= at][-1]


def test_sections_equal_brute_force(spark):
    docs = paged()
    rows = [(d, seq, f"p{seq}", text, "x") for d, pages in docs.items() for seq, text in pages]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page_seq long, page string, text string, number string").repartition(3)
    found = {(r["doc_id"], r["number"]): (r["page"], r["text"], [(p["begins"], p["page"]) for p in r["places"]]) for r in articles.sections(df).collect()}
    expected = {}
    for d, pages in docs.items():
        text, spans = joined_of(pages)
        starts = [m.start() for m in MARK.finditer(text)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]), 1):
            own = " ".join(text[a:b].split())
            places, length = [], 0
            for (s, seq), (e, _) in zip(spans, [*spans[1:], (len(text), None)]):
                piece = " ".join(text[max(a, s) : min(b, e)].split()) if max(a, s) < min(b, e) else ""
                if piece:
                    places.append((length, f"p{seq}"))
                    length += len(piece) + 1
            expected[d, n] = (f"p{page_of(spans, a)}", own, places)
    assert found == expected


def test_offsets_find_their_pages(spark):
    docs = paged(5)
    rows = [(d, seq, f"p{seq}", text or "") for d, pages in docs.items() for seq, text in pages]
    points, expected = [], []
    for d, pages in docs.items():
        text, spans = joined_of(pages)
        for at in range(0, len(text) + 1, 1 + len(text) // 50):
            points.append((d, at, "kept"))
            expected.append((d, at, page_of(spans, at)))
    points += [(1000, 3, "no document"), (0, -1, "before")]
    expected += [(1000, 3, None), (0, -1, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_seq long, page string, text string")
    found = articles.page_at(spark.createDataFrame(points, "doc_id long, offset long, note string"), pages)
    assert found.columns == ["doc_id", "offset", "note", "page_seq", "page"]
    assert sorted((r["doc_id"], r["offset"], r["page_seq"]) for r in found.collect() if r["page_seq"] is not None) == sorted(x for x in expected if x[2] is not None)
    assert found.count() == len(expected)


def facts_of(spark, *texts):
    df = spark.createDataFrame([(1, k, str(k), t) for k, t in enumerate(texts, 1)], "doc_id long, page_seq long, page string, text string")
    return {r["field"]: (r["text"], r["page"], r["found_on"]) for r in articles.article_facts(df).collect()}


def test_fields_of_articles(spark):
    found = facts_of(
        spark,
        "Préambule\nARTICLE 1 : OBJET DU MARCHE\nLe présent marché a pour objet l'acquisition de licences. A cet effet, un lot est prévu. Suite.\nARTICLE 2 : DATE LIMITE",
        "DE REMISE\nLes offres doivent parvenir par voie postale (La date limite est le 12 mars 2024 à 10h). Fin.",
        "ARTICLE 3 : RECEPTION\nLa réception provisoire est faite sur site. Elle dure. La réception définitive suit un an.",
        "ARTICLE 4 : DELAI DE GARANTIE\nLe délai de garantie est long. ARTICLE 5 : GARANTIE\nLa durée de garantie est de 24 mois.",
        "ARTICLE 6 : MODALITES DE PAIEMENT\nParties égales.",
        "Puis virement. ARTICLE 7 : CONDITIONS DE PAIEMENT\nÀ 60 jours.",
    )
    assert found["subject"] == ("Le présent marché a pour objet l'acquisition de licences. A cet effet, un lot est prévu", "1", "1")
    assert found["deadline"] == ("12 mars 2024 à 10h", "1", "2")
    assert found["submission_method"] == ("Les offres doivent parvenir par voie postale", "1", "2")
    assert found["reception"][0] == "ARTICLE 3 : RECEPTION La réception provisoire est faite sur site La réception définitive suit un an"
    assert found["guarantee"] == ("ARTICLE 5 : GARANTIE La durée de garantie est de 24 mois", "4", "4")
    assert found["payment"][1:] == ("5", "5") and "virement" in found["payment"][0] and "60 jours" in found["payment"][0]


def test_no_facts(spark):
    assert facts_of(spark, "no article here", None, "") == {}
    assert facts_of(spark, "ARTICLE 1 OBJET\nLes dispositions fixent les procédures de passation.") == {}
    empty = spark.createDataFrame([], "doc_id long, page_seq long, page string, text string")
    assert articles.article_facts(empty).count() == 0 and articles.sections(empty).count() == 0


def test_articles_that_do_not_fit_are_not_searched(spark):
    text = F.lit("ARTICLE 9 : DIVERS Les offres doivent parvenir le 12/03/2020. Les offres sont valables 60 jours.")
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.struct(x.alias("plain"), T.fold(x).alias("folded")))
    a = {"text": text, "folded": T.fold(text), "title": F.lit("article 9 : divers"), "sentences": sentences, "start": T.fold(text)}
    made = [articles._subject(a), articles._deadline(a), articles._arrival(a), articles._ruled(articles.ARTICLE_RULES[0], a)]
    assert set(spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(c for pair in made for c in pair)]).first()) == {None}
