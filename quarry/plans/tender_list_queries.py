"""Queries over Arabic tenders and price tables that are written from customers, their orders and what these order.

The texts hold the tables' values in the forms that the operators have to read: numbered
lines over page breaks, rows with bars, windows, rows of tables, lines that begin with a
quantity, and rows torn by line breaks. The SQL reads the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bidi import visual_lines as turned
from ..operators import list_evidence, listings, requested
from ..session import dealt, spread, table
from .registry import register

#: What stands before an order's number in a list, by the order's status.
ARABIC_ITEMS = {"F": "نظير من كراس الشروط رقم", "O": "جذاذات فنية للطلب رقم", "P": "جدول الأثمان رقم"}
#: The headings of the three lists and the line behind them.
ARABIC_HEADS = {"F": "I. الوثائق الإدارية وتتكون من:", "O": "II. الوثائق الخاصة بالعرض الفني:", "P": "III. وثائق الخاصة بالعرض المالي:"}
ARABIC_END = "الفصل 5: فتح العروض"
FIELDS = {"F": "administrative_documents", "O": "technical_documents", "P": "financial_documents"}


def _arabic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, k, text): lines of each customer's tender, ordered by part and k; k = 0 is a heading."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(list(FIELDS))).select("o_custkey", "o_orderkey", "o_orderstatus")
    part = lambda c: F.when(c == "F", 1).when(c == "O", 2).otherwise(3)
    said = F.lit(None).cast("string")
    for status, words in ARABIC_ITEMS.items():
        said = F.when(F.col("o_orderstatus") == status, words).otherwise(said)
    items = orders.select(F.col("o_custkey").alias("doc_id"), part(F.col("o_orderstatus")).alias("part"), F.col("o_orderkey").alias("k"), F.concat(F.lit("- "), said, F.lit(" "), F.col("o_orderkey")).alias("text"))
    heads = [F.struct(F.lit(n).alias("part"), F.lit(-1).cast("long").alias("k"), F.lit(t).alias("text")) for n, t in enumerate([*ARABIC_HEADS.values(), ARABIC_END], 1)]
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(*heads)))
    return own.unionByName(items)


def arabic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_seq, page, text): the lines dealt to pages of two to four lines."""
    lines = F.array_sort(F.collect_list(F.struct("part", "k", "text")))
    docs = _arabic_lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(lines, lambda x: x["text"]).alias("_l"))
    size = (F.col("doc_id") % 3 + 2).cast("int")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / size).cast("int")), lambda p: F.array_join(F.slice("_l", p * size + 1, size), "\n"))
    return docs.select("doc_id", F.posexplode(pages).alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("page_seq"), (F.col("_p") + 1).cast("string").alias("page"), "text")


def _cases(column: str, of: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


@register("arabic_listings", f"""
WITH lines AS (
  SELECT c_custkey AS doc_id, part, -1 AS k, NULL AS status FROM customer CROSS JOIN (VALUES (1), (2), (3), (4)) AS p(part)
  UNION ALL SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey, o_orderstatus
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O', 'P')),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1) // (doc_id % 3 + 2) + 1 AS page_seq FROM lines),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY k) AS position FROM dealt WHERE status IS NOT NULL)
SELECT doc_id, {_cases("status", FIELDS)} AS field, CAST(position AS INT) AS position, {_cases("status", ARABIC_ITEMS)} || ' ' || k AS text, CAST(page_seq AS VARCHAR) AS page
FROM numbered WHERE position <= 12""")
def arabic_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lists of every Arabic tender, each item with the page on which it stands."""
    found = listings.listings(arabic_pages(spark, sf_dir))
    return found.select("doc_id", "field", F.posexplode("items").alias("_i", "_x")).select("doc_id", "field", (F.col("_i") + 1).alias("position"), "_x.text", "_x.page")


@register("arabic_tables", f"""
WITH n AS (
  SELECT o_custkey AS doc_id, o_orderstatus AS status, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS many
  FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
SELECT doc_id, {_cases("status", FIELDS)} AS field, count(*) AS n_items,
       string_agg({_cases("status", {**ARABIC_ITEMS, "O": "الخاصيات الفنية رقم"})} || ' ' || o_orderkey, '; ' ORDER BY o_orderkey) AS items
FROM n WHERE many >= CASE WHEN status = 'F' THEN 4 ELSE 2 END GROUP BY doc_id, status""")
def arabic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each customer's table of documents, given to their fields by their words."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(list(FIELDS)))
    said = F.lit(None).cast("string")
    for status, words in {**ARABIC_ITEMS, "O": "الخاصيات الفنية رقم"}.items():
        said = F.when(F.col("o_orderstatus") == status, words).otherwise(said)
    row = F.concat(F.lit("| "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" | "), said, F.lit(" "), F.col("o_orderkey"), F.lit(" | نعم |"))
    own = dealt(orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey")
    rows = own.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("_r"))
    text = F.concat(F.lit("الوثائق المكونة للعرض\n| عدد | الوثيقة | الختم |\n|---|---|---|\n"), F.array_join(F.transform("_r", lambda x: x["row"]), "\n"))
    found = listings.listings(rows.select("doc_id", F.lit(1).alias("page_seq"), F.lit("1").alias("page"), text.alias("text")))
    return found.select("doc_id", "field", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["text"]), "; ").alias("items"))


@register("arabic_facts", """
WITH o AS (
  SELECT o_custkey AS doc_id, count(*) AS n, strftime(max(o_orderdate), '%d/%m/%Y') AS day, CAST(floor(sum(o_totalprice) / 1000) AS BIGINT) AS total
  FROM orders GROUP BY o_custkey)
SELECT doc_id, 'deadline' AS field, 'آخر أجل لقبول العروض يوم ' || day || ' على الساعة العاشرة' AS text, '1' AS page FROM o
UNION ALL SELECT doc_id, 'validity', 'الفصل 6: صلاحية العروض مدة ' || (n + 60) || ' يوما', '2' FROM o
UNION ALL SELECT doc_id, 'caution', 'الفصل 7: الضمان الوقتي قدره ' || total || ' دينار', '2' FROM o
UNION ALL SELECT doc_id, 'opening', 'الفصل 8: فتح الظروف في جلسة علنية يوم ' || day, '2' FROM o
UNION ALL SELECT doc_id, 'definitive_caution', 'الضمان النهائي ' || (n % 10 + 1) || '% من قيمة الصفقة', '3' FROM o""")
def arabic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five facts of every customer's Arabic tender, each with its page."""
    # a sum of doubles depends on the order of its rows
    total = F.floor(F.sum(F.col("o_totalprice").cast("decimal(20,6)")) / 1000).cast("bigint")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "dd/MM/yyyy").alias("day"), total.alias("total")
    )
    pages = F.array(
        F.format_string("آخر أجل لقبول العروض يوم %s\nعلى الساعة العاشرة", "day"),
        F.format_string("الفصل 6: صلاحية العروض\nمدة %d يوما\nالفصل 7: الضمان الوقتي\nقدره %d دينار\nالفصل 8: فتح الظروف في جلسة علنية يوم %s", F.col("n") + 60, F.col("total"), F.col("day")),
        F.format_string("الضمان النهائي %d%% من قيمة الصفقة", F.col("n") % 10 + 1),
    )
    own = orders.select("doc_id", F.posexplode(pages).alias("_p", "text")).select("doc_id", F.col("_p").alias("page_seq"), (F.col("_p") + 1).cast("string").alias("page"), "text")
    return listings.arabic_facts(own)


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_seq, page, text): each order's price table, by its key as a table's rows, as lines, or as torn text."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    name = F.concat_ws(" ", "p_name", F.concat(F.lit("type"), F.col("p_size")))
    row = F.struct(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), name.alias("name"), F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_suppkey").alias("s"))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    each = lambda made, sep: F.array_join(F.transform("_r", made), sep)
    texts = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("N° Désignation Unité Quantité\n"), each(lambda x: F.concat_ws(" ", x["k"].cast("string"), x["name"], F.lit("lot"), x["q"]), "\n")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Quantité Désignation\n"), each(lambda x: F.concat_ws(" ", x["q"], x["name"]), "\n")))
        # here every blank may be a line break
        .otherwise(F.concat(F.lit("Quantité\nDésignation "), each(lambda x: F.when(x["s"] % 2 == 0, F.concat_ws("\n", x["q"], F.replace(x["name"], F.lit(" "), F.lit("\n")))).otherwise(F.concat_ws(" ", x["q"], x["name"])), "\n")))
    )
    return docs.select("doc_id", F.lit(1).alias("page_seq"), F.lit("1").alias("page"), texts.alias("text"))


@register("requested_items", """
WITH r AS (
  SELECT l_orderkey AS doc_id, p_name || ' type' || p_size AS designation,
         CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE WHEN l_orderkey % 3 = 0 THEN ' lot' ELSE '' END AS quantity,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, p_name || ' type' || p_size, CAST(CAST(l_quantity AS INT) AS VARCHAR), l_suppkey) AS k
  FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, designation, CASE WHEN doc_id % 3 = 1 THEN quantity END ORDER BY k) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS number, designation, quantity FROM d""")
def requested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order asks for, read back from its price table."""
    return requested.requested_items(item_pages(spark, sf_dir)).select("doc_id", "number", "designation", "quantity")


@register("mined_items", """
SELECT l_orderkey AS doc_id, 'requested_item' AS type, p_name || ' type' || p_size AS label,
       arg_min(CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' lot', (l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR))) AS value
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, p_name || ' type' || p_size""")
def mined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every order's table as mined facts."""
    return requested.mined_items(item_pages(spark, sf_dir)).select("doc_id", "type", "label", "value")


@register("visual_lines", f"""
SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey || chr(10) || o_orderkey || reverse('- ' || {_cases("o_orderstatus", ARABIC_ITEMS)} || ' ') AS text
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's item in visual order below a line that stays as it is."""
    said = F.lit(None).cast("string")
    for status, words in ARABIC_ITEMS.items():
        said = F.when(F.col("o_orderstatus") == status, words).otherwise(said)
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(list(FIELDS)))
    text = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit("\n- "), said, F.lit(" "), F.col("o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), turned(text).alias("text"))


#: What an order's item says in the French lists, by its status.
EVIDENCE = {"F": "Documentation technique du dossier", "O": "Autorisation du constructeur pour le dossier", "P": "Caution provisoire en dinars :"}


def evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, items, source): each customer's orders as technical documents, the urgent ones as administrative ones."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(list(FIELDS))).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    said = F.lit(None).cast("string")
    for status, words in EVIDENCE.items():
        said = F.when(F.col("o_orderstatus") == status, words).otherwise(said)
    amount = F.when(F.col("o_orderstatus") == "P", F.concat(F.col("o_orderkey"), F.lit(" dinars"))).otherwise(F.col("o_orderkey").cast("string"))
    item = lambda text: F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("text"), F.lit("1").alias("page"))))
    lists = lambda rows, field, text: dealt(rows, "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(item(text).alias("_l")).select(
        "doc_id", F.lit(field).alias("field"), F.transform("_l", lambda x: F.struct(x["text"].alias("text"), x["page"].alias("page"))).alias("items"), F.lit("list").alias("source"))
    urgent = orders.where("o_orderpriority LIKE '1%'")
    technical = lists(orders, "technical_documents", F.concat(F.lit("- "), said, F.lit(" "), amount))
    return technical.unionByName(lists(urgent, "administrative_documents", F.concat(F.lit("2) Attestation de bonne execution "), F.col("o_orderkey"))))


@register("promoted_facts", """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
f AS (
  SELECT o_custkey AS doc_id, 'manufacturer_authorization' AS field, 'Autorisation du constructeur pour le dossier ' || min(o_orderkey) AS text, 'technical_documents' AS derived_from
  FROM o WHERE o_orderstatus = 'O' GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'caution', 'Caution provisoire en dinars : ' || min(o_orderkey) || ' dinars', 'technical_documents' FROM o WHERE o_orderstatus = 'P' GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'references', 'Attestation de bonne execution ' || min(o_orderkey), 'administrative_documents' FROM o WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey)
SELECT doc_id, field, text, '1' AS page, derived_from FROM f JOIN customer ON c_custkey = doc_id WHERE NOT (field = 'caution' AND c_acctbal > 3000)""")
def promoted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer's lists tell of three fields; who has an account of more than 3000 has a caution already."""
    known = spread(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("doc_id"), F.lit("caution").alias("field"),
        F.when(F.col("c_acctbal") > 3000, F.concat(F.lit("Caution provisoire de "), F.floor("c_acctbal"), F.lit(" dinars"))).otherwise("Caution provisoire").alias("text"),
    )
    return list_evidence.promoted(evidence_lists(spark, sf_dir), known)


@register("merged_lists", """
WITH n AS (
  SELECT o_custkey AS doc_id, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey)
SELECT doc_id, CASE WHEN b > 0 AND (a < 2 OR b > a) THEN 'candidate' ELSE 'current' END AS source, CASE WHEN b > 0 AND (a < 2 OR b > a) THEN b ELSE a END AS n_items, a + b AS n_united
FROM n""")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's list of filled orders against that of open ones: which is taken, and how many items both have."""
    orders = table(spark, sf_dir, "orders")

    def lists(status: str, source: str) -> DataFrame:
        item = F.struct(F.concat(F.lit(EVIDENCE[status] + " "), F.col("o_orderkey")).alias("text"), F.lit("1").alias("page"))
        own = orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        return own.select("doc_id", F.lit("technical_documents").alias("field"), "items", F.lit(source).alias("source"))

    current, candidate = lists("F", "current"), lists("O", "candidate")
    both = list_evidence.united(current, candidate).select("doc_id", F.size("items").cast("long").alias("n_united"))
    return list_evidence.merged(current, candidate).select("doc_id", "source", F.size("items").cast("long").alias("n_items")).join(both, "doc_id")
