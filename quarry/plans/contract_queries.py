"""Queries over tender documents that are written from the customers' orders.

A document says in French sentences what the tables say in columns; its lines are dealt
to pages, so that articles run over page breaks. What the operators read out of the texts
is held against SQL over the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import answers, articles, facts, nearby
from ..session import dealt, spread, table
from .registry import register

#: The lines of a document: a null column leaves its line out. {0} is the customer's value.
LINES = [
    ("Cahier des charges de {0}", "c_name"),
    ("ARTICLE 1 : OBJET DE LA CONSULTATION", None),
    ("La présente consultation a pour objet la fourniture du lot {0}.", "c_mktsegment"),
    ("ARTICLE 2 : DATE LIMITE DE REMISE DES OFFRES", "day"),
    ("Les offres doivent parvenir au bureau d'ordre en {0} exemplaires.", "n_orders"),
    ("La date limite est fixée au {0} à midi.", "day"),
    ("ARTICLE 3 : VALIDITE DES OFFRES", None),
    ("Les soumissionnaires restent engagés par leurs offres pendant {0} jours.", "days"),
    ("ARTICLE 4 : CAUTIONS", "total"),
    ("Le montant de la caution provisoire est de {0} dinars.", "total"),
    ("Le cautionnement définitif est fixé à {0} % du montant.", "percent"),
    ("ARTICLE 5 : DELAI DE GARANTIE", None),
    ("Le délai de garantie est fixé à {0} mois.", "months"),
    ("ARTICLE 6 : PENALITES DE RETARD", None),
    ("La pénalité de retard est de {0} dinars par jour.", "balance"),
    ("ARTICLE 7 : MODALITES DE PAIEMENT", "n_orders"),
    ("Le règlement de {0} factures suit.", "n_orders"),
]

#: The columns of the lines, over the customers and their orders. {total}: a sum of doubles depends on the order of
#: its rows, which a shuffle does not keep; the documents are written from exact sums.
VALUES = """
values_of AS (
  SELECT c_custkey AS doc_id, c_name, c_mktsegment, n_orders, day, total, {whole}(c_custkey % 90 + 30) AS days,
         CASE WHEN total IS NOT NULL THEN {whole}(c_custkey % 9 + 1) END AS percent, {whole}(c_nationkey + 6) AS months,
         {whole}(abs(floor(c_acctbal))) AS balance, c_custkey % 3 + 1 AS a_page
  FROM {customer} LEFT JOIN (
    SELECT o_custkey, {whole}(count(*)) AS n_orders, {day} AS day, {whole}(floor({total} / 1000)) AS total
    FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a_page, lines): the lines of each customer's document, and how many of them stand on a page."""
    values = VALUES.format(whole="bigint", day="date_format(max(o_orderdate), 'dd/MM/yyyy')", total="sum(CAST(o_totalprice AS DECIMAL(20, 6)))", customer="{customer}", orders="{orders}")
    rows = spark.sql(f"WITH {values} SELECT * FROM values_of", customer=table(spark, sf_dir, "customer"), orders=table(spark, sf_dir, "orders"))
    rows, made = dealt(rows, "doc_id"), []
    for line, column in LINES:
        head, *tail = line.split("{0}")
        made.append(F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail[0])) if tail else F.when(F.col(column).isNotNull(), head) if column else F.lit(line))
    return rows.select("doc_id", "a_page", F.array_compact(F.array(*made)).alias("lines"))


def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a_page, line, text): the lines of each customer's document, one by one."""
    return _documents(spark, sf_dir).select("doc_id", "a_page", F.posexplode("lines").alias("line", "text"))


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_seq, page, text): the lines dealt to pages."""
    size = F.col("a_page").cast("int")
    last = F.floor((F.size("lines") - 1) / size).cast("int")
    pages = F.transform(F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice("lines", p * size + 1, size), "\n"))
    each = _documents(spark, sf_dir).select("doc_id", F.posexplode(pages).alias("_p", "text"))
    return each.select("doc_id", (F.col("_p") + 1).cast("long").alias("page_seq"), (F.col("_p") + 1).cast("string").alias("page"), "text")


def _said(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _text(line: str, column: str | None) -> str:
    head, *tail = line.split("{0}")
    if tail:
        return f"{_said(head)} || {column} || {_said(tail[0])}"
    return f"CASE WHEN {column} IS NOT NULL THEN {_said(line)} END" if column else _said(line)


#: The same lines as SQL for the oracles: (doc_id, n, line, text, page), n the place in LINES.
SQL_LINES = (
    "WITH " + VALUES.format(whole="CAST", day="strftime(max(o_orderdate), '%d/%m/%Y')", total="sum(o_totalprice)", customer="customer", orders="orders")
    .replace("CAST(c_custkey % 90 + 30)", "CAST(c_custkey % 90 + 30 AS BIGINT)").replace("CAST(c_custkey % 9 + 1)", "CAST(c_custkey % 9 + 1 AS BIGINT)")
    .replace("CAST(c_nationkey + 6)", "CAST(c_nationkey + 6 AS BIGINT)").replace("CAST(abs(floor(c_acctbal)))", "CAST(abs(floor(c_acctbal)) AS BIGINT)")
    .replace("CAST(count(*))", "count(*)").replace("CAST(floor(sum(o_totalprice) / 1000))", "CAST(floor(sum(o_totalprice) / 1000) AS BIGINT)")
    + ", said AS ("
    + " UNION ALL ".join(f"SELECT doc_id, a_page, {n} AS n, {_text(*line)} AS text FROM values_of" for n, line in enumerate(LINES))
    + """), lines AS (
  SELECT doc_id, n, text, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) // a_page + 1 AS VARCHAR) AS page
  FROM said WHERE text IS NOT NULL)"""
)


def _fact(field: str, head: int, line: int, text: str) -> str:
    """A fact whose article begins at line ``head`` and which stands from ``line`` on."""
    return (
        f"SELECT v.doc_id, '{field}' AS field, {text} AS text, h.page, l.page AS found_on FROM values_of v "
        f"JOIN lines h ON h.doc_id = v.doc_id AND h.n = {head} JOIN lines l ON l.doc_id = v.doc_id AND l.n = {line}"
    )


FACTS_SQL = " UNION ALL ".join([
    _fact("subject", 1, 2, "rtrim(l.text, '.')"),
    _fact("deadline", 3, 5, "day"),
    _fact("submission_method", 3, 4, "rtrim(l.text, '.')"),
    _fact("validity", 6, 6, "'Les soumissionnaires restent engagés par leurs offres pendant ' || days || ' jours'"),
    _fact("caution", 8, 8, "'ARTICLE 4 : CAUTIONS Le montant de la caution provisoire est de ' || total || ' dinars'"),
    _fact("definitive_caution", 8, 10, "rtrim(l.text, '.')"),
    _fact("guarantee", 11, 11, "'ARTICLE 5 : DELAI DE GARANTIE Le délai de garantie est fixé à ' || months || ' mois'"),
    _fact("penalties", 13, 13, "'ARTICLE 6 : PENALITES DE RETARD La pénalité de retard est de ' || balance || ' dinars par jour'"),
    _fact("payment", 15, 16, "rtrim(l.text, '.')"),
])
ARTICLE_SQL = SQL_LINES + " " + FACTS_SQL


@register("article_facts", ARTICLE_SQL)
def article_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.article_facts(contract_pages(spark, sf_dir))


@register("article_sections", SQL_LINES + """,
headed AS (SELECT *, count(*) FILTER (text LIKE 'ARTICLE %') OVER (PARTITION BY doc_id ORDER BY n) AS number FROM lines)
SELECT doc_id, number, min_by(page, n) AS page, string_agg(text, ' ' ORDER BY n) AS text, count(DISTINCT page) AS n_pages
FROM headed WHERE number > 0 GROUP BY doc_id, number""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles.sections(contract_pages(spark, sf_dir))
    return found.select("doc_id", F.col("number").cast("long").alias("number"), "page", "text", F.size("places").cast("long").alias("n_pages"))


@register("offset_pages", """
WITH t AS (
  SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM conversations)
SELECT conv_id, CAST(start + instr(text, '.') - 1 AS BIGINT) AS "offset", turn AS page_seq, CAST(turn AS VARCHAR) AS page FROM t WHERE contains(text, '.')""")
def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that holds the first full stop of each turn, found by its offset in the conversation's text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_seq"), F.col("turn").cast("string").alias("page"), "text")
    stops = articles.offsets(turns, "conv_id", "page_seq").where(F.contains("text", F.lit("."))).select("conv_id", (F.col("start") + F.instr("text", F.lit(".")) - 1).cast("long").alias("offset"))
    return articles.page_at(stops, turns, "conv_id")


FIELDS = ["deadline", "caution", "definitive_caution", "guarantee"]


@register("contract_fields", SQL_LINES + " " + " UNION ALL ".join([
    "SELECT v.doc_id, 'deadline' AS field, day AS text, page FROM values_of v JOIN lines l ON l.doc_id = v.doc_id AND n = 5",
    "SELECT v.doc_id, 'caution', 'caution provisoire est de ' || total || ' dinars', page FROM values_of v JOIN lines l ON l.doc_id = v.doc_id AND n = 9",
    "SELECT v.doc_id, 'definitive_caution', 'cautionnement définitif est fixé à ' || percent || ' %', page FROM values_of v JOIN lines l ON l.doc_id = v.doc_id AND n = 10",
    # with its heading, where both stand on one page
    "SELECT v.doc_id, 'guarantee', CASE WHEN h.page = l.page THEN 'GARANTIE Le délai de ' ELSE '' END || 'garantie est fixé à ' || months || ' mois', l.page "
    "FROM values_of v JOIN lines h ON h.doc_id = v.doc_id AND h.n = 11 JOIN lines l ON l.doc_id = v.doc_id AND l.n = 12",
]))
def contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules of four fields, their patterns tried only on pages that hold the rule's phrases."""
    return facts.field_facts(contract_pages(spark, sf_dir), [r for r in facts.DEFAULT_FIELDS if r.field in FIELDS])


@register("believed_lines", SQL_LINES + r""",
f AS (SELECT doc_id, n, text AS t, strip_accents(lower(text)) AS x FROM lines),
c AS (
  SELECT *, x LIKE 'article%' AND length(x) <= 140
    AND NOT regexp_matches(x, ' est | sont | sera | seront | doit | doivent | fixe | pay| par jour|reception (quantitative|provisoire|definitive)') AS contents FROM f),
r AS (
  SELECT doc_id, n, 'deadline' AS field, NOT contents AND regexp_matches(t, '\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}') AS good FROM c
  UNION ALL
  SELECT doc_id, n, 'penalties', NOT contents AND NOT starts_with(x, 'resiliation') AND contains(x, 'penalite') AND regexp_matches(x, 'retard|jour|pour mille') FROM c
  UNION ALL
  SELECT doc_id, n, 'validity', NOT contents AND NOT (regexp_matches(x, 'caution|garantie|execution|contrat|marche|bancaire') AND NOT regexp_matches(x, 'offre|soumission|valable'))
    AND (regexp_matches(x, 'validite de la soumission|validite de l''offre|validite des offres|valable')
         OR regexp_matches(x, '\b(\d+ ?(jours?|mois|ans?)|90|120|60|180|quatre[- ]vingt[- ]dix|trois mois|six mois)\b')) FROM c
  UNION ALL
  SELECT doc_id, n, 'definitive_caution', NOT contents AND regexp_matches(x, 'definit|bonne fin|bonne execution')
    AND NOT regexp_matches(x, 'annexe|modele|formulaire')
    AND (regexp_matches(t, '(?i)\b\d[\d\s.,()]*\s*(DT|TND|dinars?)\b') OR regexp_matches(t, '\b\d+([.,]\d+)?\s*%(\s|$|[.;,)])')
         OR regexp_matches(x, '\b(douze|cinq|dix|vingt) mille\b|exige|doit fournir|doit constituer')) FROM c)
SELECT doc_id, field, count(*) AS n_lines, count(*) FILTER (good) AS n_good, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (good), '') AS good
FROM r GROUP BY doc_id, field""")
def believed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document the rule table believes as facts of four fields."""
    lines = contract_lines(spark, sf_dir)
    # the place in LINES, found by the line's beginning, since null lines are left out
    place = F.lit(None).cast("int")
    for n, (line, _) in reversed(list(enumerate(LINES))):
        place = F.when(F.startswith("text", F.lit(line.split("{0}")[0])), n).otherwise(place)
    tried = lines.select("doc_id", place.alias("n"), "text", F.explode(F.array(*map(F.lit, ["deadline", "penalties", "validity", "definitive_caution"]))).alias("field"))
    read = tried.withColumn("good", facts.reliable(F.col("field"), F.col("text")))
    numbers = F.array_sort(F.collect_list(F.when(F.col("good"), F.col("n"))))
    return read.groupBy("doc_id", "field").agg(
        F.count("*").alias("n_lines"), F.count(F.when(F.col("good"), 1)).alias("n_good"), F.array_join(numbers.cast("array<string>"), ",").alias("good")
    )


@register("near_deadlines", SQL_LINES + " SELECT v.doc_id, day AS text, page FROM values_of v JOIN lines l ON l.doc_id = v.doc_id AND n = 5")
def near_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.deadlines(contract_pages(spark, sf_dir))


@register("near_numbers", r"""
WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents),
a AS (
  SELECT doc_id, sum(length(b) + 6) OVER (PARTITION BY doc_id ORDER BY i) - 6 AS p
  FROM (SELECT doc_id, unnest(string_split(t, 'licens')) AS b, generate_subscripts(string_split(t, 'licens'), 1) AS i, len(string_split(t, 'licens')) AS n FROM d)
  QUALIFY i < n),
v AS (
  SELECT doc_id, sum(length(b) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS p, x
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[0-9]+')) AS b, unnest(regexp_extract_all(text, '[0-9]+')) AS x,
               generate_subscripts(string_split_regex(text, '[0-9]+'), 1) AS i FROM d WHERE regexp_matches(text, '[0-9]'))
  WHERE x IS NOT NULL),
j AS (SELECT a.doc_id, a.p, v.p AS v_p, x FROM a LEFT JOIN v ON v.doc_id = a.doc_id AND v.p >= a.p QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.p ORDER BY v.p) = 1)
SELECT doc_id, CAST(p AS BIGINT) AS "at", CASE WHEN v_p + length(x) <= p + 60 THEN x END AS value FROM j""")
def near_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mention of a licence in a document the next number within 60 characters."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    anchors = nearby.matches(docs, ["doc_id"], "text", "(?i)licens")
    return nearby.next_values(anchors, nearby.matches(docs, ["doc_id"], "text", "[0-9]+"), ["doc_id"], 60)


#: The fixed questions with their numbers.
_CHECKED = [(n + 1, question, field, presence) for n, (question, field, presence) in enumerate(rules.CHECKLIST)]


@register("contract_checklist", SQL_LINES + ", told AS (" + FACTS_SQL + "), asked(number, question, field, presence) AS (VALUES "
    + ", ".join(f"({n}, {_said(q)}, {_said(f)}, {str(p).lower()})" for n, q, f, p in _CHECKED) + f""")
SELECT v.doc_id, CAST(number AS INT) AS number, question, field,
       CASE WHEN t.text IS NULL THEN {_said(answers.NOT_FOUND["fr"])} WHEN presence THEN 'Oui - ' || t.text
            ELSE t.text END AS answer
FROM (SELECT doc_id FROM values_of) v CROSS JOIN asked LEFT JOIN told t USING (doc_id, field)""")  # fmt: skip
def contract_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed questions answered from the articles of every document, with their yes or no."""
    pages = contract_pages(spark, sf_dir)
    return answers.flagged_checklist(articles.article_facts(pages), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")))
