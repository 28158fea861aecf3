"""Reconciliation, comparison, quote checks and golden evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def key_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of each document; those without key under null."""
    return chunks.groupBy(key).agg(F.count("*").alias("n"))


def reconciliation(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (id, status, chunk_count) against the chunks that exist (doc_id): one row for each id of either."""
    counts = key_counts(chunks.where(F.col("doc_id").isNotNull()))
    joined = documents.join(counts, documents["id"] == counts["doc_id"], "full_outer")
    state = (
        F.when(F.col("id").isNull(), "orphan")
        .when(F.col("doc_id").isNull() & (F.col("chunk_count") > 0), "missing")
        .when(F.col("doc_id").isNotNull() & (F.col("status") != "indexed"), "status_mismatch")
        .when(F.coalesce("n", F.lit(0)) != F.col("chunk_count"), "count_mismatch")
        .otherwise("ok")
    )
    return joined.select(F.coalesce("id", "doc_id").alias("id"), F.coalesce("n", F.lit(0)).alias("n_chunks"), state.alias("state"))


def repairs(documents: DataFrame, chunks: DataFrame, missing_failed: bool = False) -> DataFrame:
    """New status and count of the documents whose record is wrong."""
    counts = key_counts(chunks.where(F.col("doc_id").isNotNull()))
    joined = documents.join(counts, documents["id"] == counts["doc_id"], "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 0, "indexed").when(F.lit(missing_failed) & (F.col("status") == "indexed"), "failed").otherwise(F.col("status"))
    changed = joined.select("id", status.alias("new_status"), n.alias("new_count"), "status", "chunk_count")
    return changed.where((F.col("new_status") != F.col("status")) | ((F.col("new_count") != F.col("chunk_count")) & (F.col("new_count") > 0))).select("id", "new_status", "new_count")


def orphans(rows: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    return rows.join(owners.select(F.col(owner_key).alias(key)), key, "left_anti")


def not_in(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Names of files that are not known, sorted."""
    return files.select(key).distinct().join(known.select(key), key, "left_anti").orderBy(key)


def compared(current: DataFrame, other: DataFrame) -> DataFrame:
    """Fields (doc_id, field, text) of two extractions, and whether they agree: equal, or one within the other."""
    clean = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"\s+", " "))
    a = current.select("doc_id", "field", clean("text").alias("a"))
    b = other.select("doc_id", "field", clean("text").alias("b"))
    agree = F.coalesce((F.col("a") == F.col("b")) | F.contains("a", "b") | F.contains("b", "a"), F.lit(False))
    return a.join(b, ["doc_id", "field"], "full_outer").select("doc_id", "field", F.col("a").isNotNull().alias("in_first"), F.col("b").isNotNull().alias("in_second"), agree.alias("agree"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != ""))


def quote_check(quote: Column, page: Column) -> Column:
    """exact, approximate or missing, and the share of the quote's distinct words that the page has."""
    own = words(quote)
    share = F.when(F.size(own) > 0, F.round(F.size(F.array_intersect(own, words(page))) / F.size(own), 3)).otherwise(F.lit(0.0))
    state = F.when(F.contains(F.lower(page), F.lower(quote)), "exact").when(share >= rules.QUOTE_SHARE, "approximate").otherwise("missing")
    return F.struct(state.alias("state"), share.alias("share"))


def evaluated(golden: DataFrame, facts: DataFrame) -> DataFrame:
    """Golden fields (doc_id, field, expected, least) against facts (doc_id, field, text), by document."""
    joined = golden.join(facts, ["doc_id", "field"], "left")
    hit = F.contains(F.lower("text"), F.lower("expected"))
    return joined.groupBy("doc_id").agg(
        F.count_if(F.coalesce(hit, F.lit(False))).alias("matched"),
        F.count_if(F.col("text").isNull()).alias("missing"),
        F.count_if(F.coalesce(~hit, F.lit(False))).alias("mismatched"),
        (F.count_if(F.coalesce(hit, F.lit(False))) >= F.max("least")).alias("passed"),
    )


def marker_score(pages: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers (page, field, marker) found in their page's text (page, text), by page; few markers, so broadcast."""
    joined = markers.join(pages, "page", "left")
    found = F.coalesce(F.contains(F.lower("text"), F.lower("marker")), F.lit(False))
    return joined.groupBy("page").agg(F.count_if(found).alias("hits"), F.count("*").alias("total"))


def best_by(rows: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group with the greatest order."""
    best = F.max_by(F.struct(*keep), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def three_way(current: DataFrame, other: DataFrame, expected: DataFrame) -> DataFrame:
    """Which of two extractions (doc_id, field, text) meets what is expected (doc_id, field, status, contains)."""
    side = lambda t, name: t.select("doc_id", "field", F.lower("text").alias(name))
    joined = expected.join(side(current, "a"), ["doc_id", "field"], "left").join(side(other, "b"), ["doc_id", "field"], "left")
    hit = lambda name: F.coalesce(F.exists("contains", lambda x: F.contains(F.col(name), F.lower(x))), F.lit(False))
    absent = lambda name: F.col(name).isNull()
    good_a = F.when(F.col("status") == "present", hit("a")).when(F.col("status") == "not_found", absent("a"))
    good_b = F.when(F.col("status") == "present", hit("b")).when(F.col("status") == "not_found", absent("b"))
    winner = (
        F.when(good_a & good_b, "both").when(good_a, "current").when(good_b, "other").when(good_a.isNotNull(), "none")
        .when(~absent("a") | ~absent("b"), "needs_review").otherwise("unknown")
    )
    return joined.select("doc_id", "field", winner.alias("winner"))


def found_documents(chunks: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Documents whose chunks have a text in one of the fields, whatever the case: number of chunks and first page."""
    hay = F.lower(F.concat_ws(" ", *fields))
    rows = chunks.where(F.contains(hay, F.lit(needle.lower())) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min_by("page", "chunk_index").alias("first_page"))


def named_like(rows: DataFrame, needle: str) -> DataFrame:
    """Rows whose name or description contains a text, whatever the case."""
    return rows.where(F.contains(F.lower("name"), F.lit(needle.lower())) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(needle.lower())))


def fact_sources(facts: DataFrame, most: int = 4) -> DataFrame:
    """Facts (doc_id, field, items of page and section) -> the distinct places of their items, at most ``most``."""
    places = F.array_distinct(F.transform("items", lambda x: F.struct(x["page"].alias("page"), F.coalesce(x["section"], F.lit("general")).alias("section"))))
    return facts.select("doc_id", "field", F.slice(places, 1, most).alias("places"))
