"""Requested items: rows, lines and torn rows."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import requested as R

SCHEMA = "doc_id long, page_seq int, page string, text string"


def read(spark, *texts):
    df = spark.createDataFrame([(1, k, f"p{k}", t) for k, t in enumerate(texts, 1)], SCHEMA)
    return [(r["item"], r["page"]) for r in R.requested_items(df).orderBy("number").collect()]


def test_rows_of_a_table(spark):
    table = "Item Désignation Unité Quantité\n1 Serveur rack U 4\nPage 2\n2 Licence antivirus poste 50\n3 serveur RACK U 9\nTotal général"
    assert read(spark, table) == [("Serveur rack : 4 U", "p1"), ("Licence antivirus : 50 poste", "p1")]
    assert read(spark, table, table) == read(spark, table)
    assert read(spark, "Désignation Unité\nQuantité 1 Serveur\nrack lot 4 2 Câble\nréseau forfait 7") == [("Serveur rack : 4 lot", "p1"), ("Câble réseau : 7 forfait", "p1")]
    df = spark.createDataFrame([(1, 1, "1", table), (1, 2, "2", table), (2, 1, "1", None)], SCHEMA)
    assert sorted(tuple(r) for r in R.mined_items(df).collect()) == [(1, "requested_item", "Licence antivirus", "50 poste", "1"), (1, "requested_item", "Serveur rack", "4 U", "1")]


def test_lines_that_begin_with_a_quantity(spark):
    assert read(spark, "Quantité Désignation\n12 Chaises pliantes\n3,5 Imprimante laser\nrien\nConditions de paiement\n7 Hors tableau") == [
        ("Chaises pliantes : 12", "p1"), ("Imprimante laser : 3,5", "p1"),
    ]


def test_rows_with_support(spark):
    got = read(spark, "Désignation Quantité Support ID\nPare-feu central 2 licences ABCD1234 #55512\nCommutateur 5 unités #77777")
    assert got == [("Pare-feu central : 2 licences, ID licence ABCD1234, Support ID #55512", "p1"), ("Commutateur : 5 unités, Support ID #77777", "p1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_breaks_do_not_matter(spark, seed):
    rng = random.Random(seed)
    words = ["routeur", "scanner", "souris", "clavier", "onduleur", "câble", "disque", "baie"]
    rows, expected = [], []
    for d in range(40):
        names = [f"{rng.choice(words)} {rng.choice(words)} type{rng.choice('ABCDEF')}" for _ in range(rng.randrange(1, 9))]
        wanted = [(n, str(rng.randrange(1, 90))) for n in names]
        tokens = ["Quantité", "Désignation"] + [t for n, q in wanted for t in [q, *n.split(" ")]]
        # the heading is torn, so that only the text without breaks tells the rows
        text = tokens[0] + "\n" + tokens[1] + "".join(rng.choice(["\n", " ", " \n "]) + t for t in tokens[2:])
        rows.append((d, 1, "1", text))
        seen = {}
        for n, q in wanted:
            seen.setdefault(n, q)
        expected += [(d, k, n, q) for k, (n, q) in enumerate(seen.items(), 1)]
    got = R.requested_items(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "number", "designation", "quantity").collect()
    assert sorted(map(tuple, got)) == expected


def test_nothing(spark):
    assert read(spark, None, "", "quantité", "Désignation Quantité", "12 chaises") == []
    assert R.requested_items(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_without_units_are_read_in_one_pass(spark):
    """Names are looked for only where a unit follows some number: these windows took two minutes before."""
    text = F.concat(F.lit("Quantité Désignation "), F.repeat(F.lit("7 small blue plate type21 "), F.lit(65)), F.col("id").cast("string"))
    pages = spark.range(0, 4000, 1, 4).select(F.lit(False).alias("f"), text.alias("w"))
    began = time.perf_counter()
    pages.select(R._window_items(F.col("w"), F.col("f")).alias("i")).where("size(i) > 0").count()
    assert time.perf_counter() - began < 60
    found = spark.createDataFrame([("Small plate 3 postes et suite",), ("Small plate 3 poste #1234",), ("Small plate 3 lots #1234",)], "w string")
    items = [[(x["designation"], x["kind"]) for x in r[0]] for r in found.select(R._window_items(F.col("w"), F.lit(False))).collect()]
    assert items == [[("Small plate", 4)], [("Small plate", 3)], []]


def test_long_tables_are_read_to_their_ends(spark):
    """Of a page's table 20 rows, and behind a heading 1,800 characters, were read before."""
    n = 1100
    names = [f"Baie {''.join(x)}" for x, _ in zip(itertools.product("bcdfghklmr", repeat=4), range(n))]
    rows = [f"{k} {x} lot {k % 90 + 1}" for k, x in enumerate(names, 1)]
    numbered = [f"{x} : {k % 90 + 1} lot" for k, x in enumerate(names, 1)]
    table = "N° Désignation Unité Quantité\n" + "\n".join([*rows, rows[0]])
    torn = "Désignation Unité\nQuantité " + "\n".join(rows).replace(" b", "\nb")
    first = "Quantité\nDésignation " + "\n".join(f"{k % 90 + 1} {x}" for k, x in enumerate(names, 1)).replace(" b", "\nb")
    support = "Désignation Quantité Support ID\n" + "\n".join(f"{x} 2 licences #{10000 + k}" for k, x in enumerate(names))
    licences = "Contrat de licence pour " + " ".join(f"{x} 2 postes" for x in names)
    items = lambda text: [item for item, _ in read(spark, text)]
    assert items(table) == numbered and items(torn) == numbered
    assert items(first) == [f"{x} : {k % 90 + 1}" for k, x in enumerate(names, 1)]
    assert items(support) == [f"{x} : 2 licences, Support ID #{10000 + k}" for k, x in enumerate(names)]
    assert {x.split(" : ")[0] for x in items(licences)} >= set(names[1:])
    df = spark.createDataFrame([(1, 1, "1", table)], SCHEMA)
    assert sorted((r["label"], r["value"]) for r in R.mined_items(df).collect()) == sorted(tuple(x.split(" : ")) for x in numbered)
    # a year before a short table's row is no row's number
    assert items("N° Désignation Unité Quantité\n1 Baie lot 4\n2024 Contrat lot 3") == ["Baie : 4 lot"]


def test_a_page_of_many_headings(spark):
    """Each heading's window holds the next ones; what they repeat is made once."""
    names = [f"Baie {a}{b}{c}" for a, b, c in itertools.product("bcdfghklmr", "aeiouy", "bcdfgh")]
    began = time.perf_counter()
    got = read(spark, "\n".join(f"Désignation Quantité {x} 2 postes" for x in names))
    assert {item.split(" : ")[0] for item, _ in got} >= set(names) and time.perf_counter() - began < 60
