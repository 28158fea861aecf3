"""Quality rules as a short-circuit cascade, in Spark's own expressions only.

Every rule is a Boolean column that is true where a document is to be rejected.
``plan`` measures on a small sample what each rule costs and how many rows it
rejects, and orders the rules by rejections per cost; ``verdict`` builds one
CASE expression in that order, so a row pays only for the rules up to the first
that rejects it. The order never changes which rows are kept.

The sample is random rows of at most ``SAMPLE_FILES`` of the table's files, so that
its cost does not grow with the table, and stays distributed as it was read. A
rule's cost is the least of ``TIMINGS`` runs over it.

Defined cases: a null or empty text has no words and is rejected by
``few_words``; null ids, repeated rows and further columns pass through
unchanged, whatever their names; rules of equal rank (ties) keep the given order;
a very long text is judged whole (``vocabulary`` asks a text of more than 1000
words for 50 distinct words, as it does one of 1000); an empty table gives an empty
result.
"""

from __future__ import annotations

import time
import zlib
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, stored

#: Rows from which costs and selectivities are estimated. They decide only the order of the rules.
SAMPLE_ROWS = 2048
#: Files from which they are read, and runs of each rule over them.
SAMPLE_FILES, TIMINGS = 8, 3
SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the text's column and its words' column."""

    name: str
    reject: object


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for a null or blank text."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    blank = F.array().cast("array<string>")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", blank).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def bound(value: Column, use) -> Column:
    """``use(value)`` where ``value`` is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long")


def _worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return bound(_worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has at least twice.

    Windows are compared by 64-bit hashes. Sorted hashes show at once whether any
    window repeats; only then are (hash, position) pairs sorted and the union of
    the repeated windows measured.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )

    def any_twice(h: Column) -> Column:
        return F.size(F.array_distinct(h)) < F.size(h)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = bound(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: F.get(s, k + 1)["h"].eqNullSafe(x["h"])
                        | ((k > 0) & F.get(s, k - 1)["h"].eqNullSafe(x["h"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return bound(
            repeated,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    counted = bound(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(
        bound(windows(w), lambda h: F.when(any_twice(h), covered(h)).otherwise(F.lit(0)))
    ))
    return counted.cast("long")


def default_rules() -> list[Rule]:
    """Rejecting rules with thresholds that ordinary prose stays far away from."""
    n = F.size
    letters = lambda t, kind: F.char_length(F.regexp_replace(t, f"[^{kind}]+", ""))
    text = lambda t: F.coalesce(t, F.lit(""))
    return [
        Rule("few_words", lambda t, w: n(w) < 50),
        Rule("symbols", lambda t, w: n_symbols(t) * 5 > n(w)),
        Rule("shouting", lambda t, w: bound(letters(text(t), r"\p{Lu}"), lambda up: (up * 2 > letters(text(t), r"\p{L}")))),
        Rule("word_length", lambda t, w: (word_chars(w) < n(w) * 2) | (word_chars(w) > n(w) * 20)),
        Rule("letters", lambda t, w: letters(text(t), r"\p{L}") * 2 < word_chars(w)),
        Rule("duplicate_lines", lambda t, w: bound(_worded_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x))),
        Rule("vocabulary", lambda t, w: F.size(F.array_distinct(w)) * 20 < F.least(n(w), F.lit(1000))),
        Rule("repeated_words", lambda t, w: n_repeat_words(w) * 2 > n(w)),
    ]


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumns({"_q_words": words_of(F.col(text_col))})


@dataclass(frozen=True)
class Estimate:
    name: str
    rejected: float
    seconds: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def sampled(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A table (_q_text, _q_words) of about ``sample_rows`` random rows from a few files of ``df``."""
    # names come as URIs, paths are asked for
    files = sorted(map(unquote, df.inputFiles()), key=lambda path: zlib.crc32(path.encode()))[:SAMPLE_FILES]
    rows = df.select(F.col(text_col).cast("string").alias("_q_text"))
    if files:
        few = df.sparkSession.read.schema(df.select(text_col).schema).parquet(*files) if _is_parquet(files) else df
        rows = few.select(F.col(text_col).cast("string").alias("_q_text"))
    share = min(1.0, sample_rows / max(1, rows.count()))
    return stored(rows.sample(share, seed=1).withColumn("_q_words", words_of(F.col("_q_text"))))


def _is_parquet(files: list[str]) -> bool:
    return all(path.endswith(".parquet") for path in files)


def plan(df: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[Rule], list[Estimate]]:
    """The rules ordered by rejections per cost on a sample, and the estimates.

    Costs are run times over the sample less the time of reading it. Rules that
    reject nothing in the sample come last, the cheapest first.
    """
    sample = sampled(df, text_col, sample_rows)
    rejects = {r.name: F.coalesce(r.reject(F.col("_q_text"), F.col("_q_words")), F.lit(False)) for r in rules}

    def timed(value: Column) -> tuple[float, float]:
        query = sample.agg(F.avg(value.cast("double")).alias("x"))
        share, took = query.collect()[0]["x"], []
        for _ in range(TIMINGS):
            began = time.perf_counter()
            query.collect()
            took.append(time.perf_counter() - began)
        return float(share or 0.0), min(took)

    _, base = timed(F.size("_q_words") < 0)
    found = []
    for r in rules:
        share, seconds = timed(rejects[r.name])
        found.append(Estimate(r.name, share, max(seconds - base, 1e-4)))
    by_name = {e.name: e for e in found}
    ordered = sorted(rules, key=lambda r: (-by_name[r.name].rank, by_name[r.name].seconds))
    return ordered, [by_name[r.name] for r in ordered]


def verdict(rules: list[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule, in this order, that rejects; null where all accept."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.coalesce(r.reject(text, words), F.lit(False)), F.lit(r.name)).otherwise(out)
    return out


def quality_rules(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the input's columns."""
    ordered, _ = plan(df, rules or default_rules(), text_col)
    # a filter on a column of words would be pushed below it and split the text anew for every rule
    failed = bound(words_of(F.col(text_col)), lambda w: verdict(ordered, F.col(text_col), w))
    return df.where(failed.isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest for every document: its statistics, the base rule and the cascade's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ordered, _ = plan(docs, cascade_rules())
    stats = with_words(docs).select(
        "doc_id",
        "text",
        "_q_words",
        F.size("_q_words").cast("long").alias("n_words"),
        word_chars(F.col("_q_words")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("_q_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(verdict(ordered, F.col("text"), F.col("_q_words")).isNull()).alias("kept"),
    )


def cascade_rules() -> list[Rule]:
    """The rules beside the two of the base, which op4 evaluates for every row anyhow."""
    return [r for r in default_rules() if r.name not in ("few_words", "repeated_words")]


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM d),
num AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM num, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2 GROUP BY doc_id),
s AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS dup,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS failed,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper_letters,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
  FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND NOT (n_symbols * 5 > n_words) AND NOT (upper_letters * 2 > letters)
         AND NOT (word_chars < n_words * 2 OR word_chars > n_words * 20)
         AND NOT (letters * 2 < word_chars) AND NOT (dup * 2 > len(lines))
         AND NOT (len(list_distinct(w)) * 20 < least(n_words, 1000)) AS kept
FROM b
"""
