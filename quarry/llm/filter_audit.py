"""Audit of the interaction of five filters by aggregation over the edges of their lattice.

A filter that runs after others removes only what they left, so what it costs depends
on the order. All 120 orders are paths through the lattice of the 32 subsets of
filters; their 600 steps share its 80 edges, an edge being (set of filters already
applied, next filter). What a step removes, keeps and finds removed already depends on
its edge alone.

Method. A document is reduced to the bit mask of the filters that it fails. Equal masks
of a part are added up, at most 32 for each, and only these sums contribute to the 80
edges; the edges' sums are then joined to the 600 steps. A filter's Shapley sum, over
all orders, weighs each of its 16 edges by the number of orders that pass it.

The filters are A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 *
capitals A-Z > 5 * code points; D: any of ``#$%&*|``; E: the text of any smaller id.

Scale. Texts stay where they are read; (id, part, digest, mask) are shuffled, first
with the labels, then by digest, copies of a text added up before. Of a text only one
row for each part and mask meets the others, so a third of all rows may be copies. All
else has at most 600 rows for a part.

Defined cases: a null text is the empty one, a null source the part "". A null id is
larger than every id and no larger than another null, and has no label. Rows that
repeat an id and a text do not make each other fail E and count one by one. An id with
several labels is good (toxic) if any of them says so. No documents give no rows.
Very long texts are judged whole; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_rules import bound, words_of

FILTERS = "ABCDE"
STEP_COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
_N = len(FILTERS)
_E = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which a text alone decides."""

    def of_words(w: Column) -> Column:
        few, poor = F.size(w) < 50, 100 * F.size(F.array_distinct(w)) < 65 * F.size(w)
        return few.cast("int") + 2 * poor.cast("int")

    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    shouting = 100 * capitals > 5 * F.char_length(text).cast("long")
    return bound(words_of(text), of_words) + 4 * shouting.cast("int") + 8 * text.rlike("[#$%&*|]").cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters that they fail."""
    c = F.col
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    rows = docs.select(c("doc_id").cast("long").alias("id"), F.coalesce(c("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(c("text")).alias("mask"))
    # rows without an id are spread by their digest and meet no label
    rows = rows.withColumns({"known": c("id").isNotNull(), "key": F.coalesce("id", F.xxhash64("digest"))})
    rows = rows.groupBy("key", "known", "id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where(c("doc_id").isNotNull()).groupBy(c("doc_id").cast("long").alias("key")).agg(
        F.max((c("quality") == 1).cast("long")).alias("good"), F.max((c("toxic") == 1).cast("long")).alias("toxic")
    )
    marked = rows.join(marks.withColumn("known", F.lit(True)), ["key", "known"], "left")
    marked = marked.withColumns({x: c("n") * F.coalesce(x, F.lit(0)) for x in ("good", "toxic")})
    rank = F.struct(c("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"))
    texts = marked.groupBy("digest", "part", "mask").agg(
        *[F.sum(x).alias(x) for x in ("n", "good", "toxic")],
        F.min(F.struct(rank.alias("rank"), "n", "good", "toxic")).alias("first"),
    )
    # the rows of the smallest id are those that do not fail E; a part has one row of them at most
    first = c("first.rank") == F.min("first.rank").over(Window.partitionBy("digest"))
    kept = {x: F.when(c("is_first"), c(f"first.{x}")).otherwise(F.lit(0)) for x in ("n", "good", "toxic")}
    sums = texts.withColumn("is_first", first).groupBy("part", "mask").agg(
        *[F.sum(kept[x]).alias(x) for x in kept], *[F.sum(c(x) - kept[x]).alias(f"{x}_e") for x in kept]
    )
    both = F.array(
        F.struct(c("mask"), *[c(x).alias(x) for x in kept]),
        F.struct((c("mask") + _E).alias("mask"), *[c(f"{x}_e").alias(x) for x in kept]),
    )
    return sums.select("part", F.inline(both))


def edges(counted: DataFrame) -> DataFrame:
    """The sums of ``masks`` on the 80 edges (part, applied, next) of the lattice."""
    c = F.col
    pairs = [(f, applied) for f in range(_N) for applied in range(1 << _N) if not applied >> f & 1]
    lattice = F.array(*[F.struct(F.lit(f).alias("next"), F.lit(s).alias("applied"), F.lit(1 << f).alias("bit")) for f, s in pairs])
    each = counted.select("*", F.inline(lattice))
    fails, gone = c("mask").bitwiseAND(c("bit")) != 0, c("mask").bitwiseAND(c("applied")) != 0
    total = lambda x, of: F.sum(F.when(of, c(x)).otherwise(F.lit(0)))
    summed = each.groupBy("part", "applied", "next").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", c("mask") == c("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(_N - 1 - k)) for k in range(_N)]), F.bit_count("applied") + 1)
    return summed.withColumn("shapley", F.sum(c("removed") * orders).over(Window.partitionBy("part", "next")))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, next) of the five steps of all 120 orders."""
    rows = []
    for order in permutations(range(_N)):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[k] for k in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part of ``docs`` (its sources), order of the filters and step."""
    # 600 rows, whatever the input
    paths = F.broadcast(steps(docs.sparkSession))
    return edges(masks(docs, labels)).join(paths, ["applied", "next"]).select("part", "filter_order", "step", *STEP_COLUMNS)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS copy
  FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part,
         CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(copy AS INT) AS mask,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT substr('ABCDE', i, 1) AS x, 1 << (i - 1) AS bit FROM (VALUES (1), (2), (3), (4), (5)) AS v(i)),
o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order
  FROM f a, f b, f c, f e, f g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, bit,
         coalesce((SELECT sum(p.bit) FROM f p WHERE contains(substr(filter_order, 1, step - 1), p.x)), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step), f WHERE f.x = substr(filter_order, step, 1)),
r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
