"""Choosing between several extractions of a page, and routing pages to recognition.

Extractors for scans and layouts are pluggable: ``recognised`` takes a function of
(content, page) and runs it where the bytes are, once for each page that the cache
misses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

#: Words that show a table of prices or articles.
TABLE_WORDS = ["designation", "qte", "prix unitaire", "caracteristique technique", "minimum demande"]


def combined(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries (.., page_seq, text) joined by page, cleaned, without empty ones."""
    listed = F.array_sort(F.collect_list(F.struct("page_seq", T.clean_text(F.col("text")).alias("t"))))
    texts = F.filter(F.transform(listed, lambda x: x["t"]), lambda x: x != "")
    return entries.groupBy(*by).agg(F.array_join(texts, "\n").alias("text"))


def best_by_page(candidates: DataFrame, score: Callable[[Column], Column] = T.quality_score) -> DataFrame:
    """Texts of pages (doc_id, page, extractor, text) -> per page the best, and others that add a table or an Arabic signal.

    Candidates of a page are few, one for each extractor, so a page is folded in
    order of score; ties go to the extractor that comes first by name.
    """
    rated = candidates.withColumn("_score", score(F.col("text")))
    rated = rated.withColumns({"_t": T.clean_text(F.col("text")), "_m": T.arabic_matching(F.col("text"))})
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_score")).alias("s"), "extractor", F.col("_t").alias("t"), F.col("_m").alias("m"))))

    def fold(state: Column, other: Column) -> Column:
        best, matched = state["best"], state["matched"]
        folded, whole = T.fold(other["t"]), T.fold(best)
        table = F.lit(False)
        for word in TABLE_WORDS:
            table = table | F.contains(folded, F.lit(word))
        adds = (table & ~F.contains(whole, folded)) | T.adds_arabic_signal(matched, other["m"])
        joined = F.struct(F.concat(best, F.lit("\n"), other["t"]).alias("best"), F.concat(matched, F.lit("\n"), other["m"]).alias("matched"))
        first = F.struct(other["t"].alias("best"), other["m"].alias("matched"))
        return F.when(best == "", first).when(adds, joined).otherwise(state)

    grouped = rated.groupBy("doc_id", "page").agg(listed.alias("_l"))
    empty = F.struct(F.lit("").alias("best"), F.lit("").alias("matched"))
    return grouped.select("doc_id", "page", F.aggregate("_l", empty, fold, lambda state: state["best"]).alias("text")).where("text <> ''")


def merged_by_page(existing: DataFrame, recognised_pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) of two sources: recognised text where there is any, else the existing.

    An existing text that has an Arabic signal which the recognised one lacks is added to it.
    """
    a = existing.select("doc_id", "page", T.clean_text(F.col("text")).alias("_a"))
    b = recognised_pages.select("doc_id", "page", T.clean_text(F.col("text")).alias("_b"))
    joined = a.join(b, ["doc_id", "page"], "full_outer")
    joined = joined.withColumns({"_am": T.arabic_matching(F.col("_a")), "_bm": T.arabic_matching(F.col("_b"))})
    adds = T.adds_arabic_signal(F.col("_bm"), F.col("_am"))
    text = F.when((F.col("_a") != "") & (F.col("_b") != "") & adds, F.concat_ws("\n", "_b", "_a")).otherwise(F.coalesce(F.nullif("_b", F.lit("")), F.nullif("_a", F.lit(""))))
    source = F.when(F.coalesce("_b", F.lit("")) != "", "recognised").otherwise("existing")
    return joined.select("doc_id", "page", text.alias("text"), source.alias("source")).where(F.col("text").isNotNull())


def scan_metrics(pages: DataFrame, useful: list[str]) -> DataFrame:
    """Per document (doc_id, page, text): pages, characters a page, mean quality, fragments, marker hits, long words."""
    hits = F.lit(0)
    folded = T.fold(F.col("text"))
    for word in useful:
        hits = hits + F.when(F.contains(folded, F.lit(word)), 1).otherwise(0)
    own = pages.withColumns({
        "_n": F.char_length("text"), "_q": T.quality_score(F.col("text")), "_f": T.short_fragment_ratio(F.col("text")), "_h": hits,
        "_w": F.regexp_count("text", F.lit(rf"[A-Za-zÀ-ÖØ-öø-ÿ{T.ARABIC}]{{4,}}")), "_p": T.page_number(F.col("page")),
    })
    return own.groupBy("doc_id").agg(
        F.coalesce(F.max("_p"), F.lit(0)).alias("pages"), (F.sum("_n") / F.greatest(F.coalesce(F.max("_p"), F.lit(0)), F.lit(1))).alias("chars_a_page"),
        F.avg("_q").alias("quality"), F.avg("_f").alias("fragments"), F.max("_h").alias("hits"), F.sum("_w").alias("long_words"),
    )


def looks_like_scan(metrics: DataFrame) -> DataFrame:
    """Whether a document's text is that of a poorly read scan; documents under eight pages never are."""
    good = (F.col("hits") >= 3) & (F.col("quality") >= 25)
    few = F.col("hits") < 3
    poor = (
        (F.col("quality") < 22)
        | ((F.col("fragments") >= 0.32) & few)
        | ((F.col("chars_a_page") < 320) & few)
        | (F.col("long_words") < F.greatest(F.lit(20), F.col("pages") * 3))
    )
    return metrics.withColumn("scan", (F.col("pages") >= 8) & ~good & poor)


def candidate_score(pages: DataFrame, bonus: dict[str, int] | None = None) -> DataFrame:
    """The best extractor of each document (doc_id, extractor, page, text) by the sum of its pages' quality and its bonus."""
    extra = F.lit(0)
    for name, points in (bonus or {}).items():
        extra = extra + F.when(F.col("extractor") == name, points).otherwise(0)
    rated = pages.groupBy("doc_id", "extractor").agg(F.sum(T.quality_score(F.col("text"))).alias("_s"), F.count("*").alias("pages"))
    rated = rated.withColumn("score", F.col("_s") + extra)
    return rated.groupBy("doc_id").agg(F.max_by(F.struct("extractor", "score", "pages"), F.struct("score", "extractor")).alias("_b")).select("doc_id", "_b.*")


def target_pages(pages: DataFrame, markers: list[str], front: int = 3, most: int = 12) -> DataFrame:
    """Pages to recognise: the first ones and those with a marker, at most ``most`` of a document."""
    hit = F.col("page_seq") <= front
    folded = T.fold(F.col("text"))
    for marker in markers:
        hit = hit | F.contains(folded, F.lit(marker))
    order = Window.partitionBy("doc_id").orderBy("page_seq")
    return pages.where(hit).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("doc_id", "page_seq")


def recognised(wanted: DataFrame, cache: DataFrame | None, recognise: Callable[[bytes, str], str], version: str) -> DataFrame:
    """Wanted images (doc_id, page, image) -> (doc_id, page, key, text); pages whose key is in the cache are not read again.

    The key is the hash of the image and of the version of the model and its prompt.
    """
    keyed = wanted.withColumn("key", F.concat_ws("-", "doc_id", "page", F.left(F.sha2("image", 256), F.lit(16)), F.lit(version)))
    todo = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [recognise(bytes(image), page) for image, page in zip(batch["image"], batch["page"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "page": batch["page"], "key": batch["key"], "text": texts})

    fresh = todo.select("doc_id", "page", "key", "image").mapInPandas(run, "doc_id string, page string, key string, text string").where(~T.is_noise(F.col("text")))
    if cache is None:
        return fresh
    held = keyed.select("doc_id", "page", "key").join(cache.select("key", "text"), "key").select("doc_id", "page", "key", "text")
    return fresh.unionByName(held)


def better_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached texts (filename, content, gaps, pages) with those of fresh ones that are at least as good."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    order = F.struct(T.quality_score(F.col("content")) - 3 * F.col("gaps"), -F.col("gaps"), F.col("pages"), F.char_length("content"), -F.col("_new"))
    return both.groupBy("filename").agg(F.max_by(F.struct("content", "gaps", "pages"), order).alias("_b")).select("filename", "_b.*")


def resolved_names(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached name of each wanted file name: the same, with blanks for underscores, or alike but for case, marks and suffix."""
    plain = lambda c: F.regexp_replace(T.fold(F.regexp_replace(c, r"\.[^.]+$", "")), r"[^a-z0-9]+", " ")
    names = cache.select(F.col("filename").alias("cached")).distinct()
    left = wanted.select(F.col("filename")).distinct()
    same = left.join(names, F.col("filename") == F.col("cached")).withColumn("_p", F.lit(0))
    spaced = left.join(names, F.replace("filename", F.lit("_"), F.lit(" ")) == F.col("cached")).withColumn("_p", F.lit(1))
    alike = left.join(names, plain(F.col("filename")) == plain(F.col("cached"))).withColumn("_p", F.lit(2))
    found = same.unionByName(spaced).unionByName(alike)
    return found.groupBy("filename").agg(F.min_by("cached", F.struct("_p", "cached")).alias("cached"))


def resolved_pages(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Page labels (doc_id, raw) of model answers -> known pages (doc_id, page): equal, by first number, or one within the other."""
    joined = asked.join(known, "doc_id")
    rank = (
        F.when(F.col("raw") == F.col("page"), 0)
        .when(T.page_number(F.col("raw")) == T.page_number(F.col("page")), 1)
        .when(F.contains("raw", "page") | F.contains("page", "raw"), 2)
    )
    ranked = joined.withColumn("_k", rank).where("_k is not null")
    return ranked.groupBy("doc_id", "raw").agg(F.min_by("page", F.struct("_k", F.struct(F.coalesce(T.page_number(F.col("page")), F.lit(10000)), "page"))).alias("page"))


def worst_mode(pages: DataFrame) -> DataFrame:
    """The worst text-quality mode of each document's pages (doc_id, mode)."""
    order = {"clean": 1, "partial_pages": 2, "noisy_ocr": 3, "arabic_noisy": 4}
    level = F.lit(0)
    for mode, n in order.items():
        level = F.when(F.col("mode") == mode, n).otherwise(level)
    return pages.groupBy("doc_id").agg(F.max_by("mode", level).alias("mode"))


def organisations(pages: DataFrame, words: list[str], first_pages: int = 2, first_lines: int = 35) -> DataFrame:
    """The line of a document's first pages that looks most like an organisation's name."""
    lines = pages.where(F.col("page_seq") <= first_pages).select("doc_id", "page_seq", "page", F.posexplode(T.lines(F.col("text"))).alias("_i", "line"))
    name = T.compact(F.col("line"))
    normal = T.normalize_query(name)
    named = F.lit(False)
    for word in words:
        named = named | F.contains(normal, F.lit(word))
    upper = T.ratio(T.chars_in(name, r"\p{Lu}"), T.chars_in(name, r"\p{L}"))
    score = (
        F.greatest(F.lit(0.0), 8.0 - F.col("_i") * 0.15)
        + F.when(upper > 0.55, 2.0).otherwise(0.0)
        + F.when(named, 3.0).otherwise(0.0)
        - F.when(~F.contains(normal, F.lit(" ")), 3.0).otherwise(0.0)
    )
    fine = (F.char_length(name).between(3, 100)) & name.rlike(r"\p{L}") & ~normal.rlike(r"\d{4}|www|\bfax\b|\btel\b|article |page |cahier des charges|appel d offres")
    scored = lines.where((F.col("_i") < first_lines) & fine).withColumn("score", score).withColumn("name", name).where("score > 0")
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("name", "page", "score"), F.struct("score", -F.col("page_seq"), -F.col("_i"))).alias("_b")).select("doc_id", "_b.*")


def quality_mode(arabic: Column, readable: Column, gaps: Column) -> Column:
    """The mode that follows from a text's shares and gaps."""
    return (
        F.when((arabic >= rules.ARABIC_LEAST) & ((readable < rules.ARABIC_READABLE) | (gaps > 0)), "arabic_noisy")
        .when(readable < rules.READABLE_LEAST, "noisy_ocr")
        .when(gaps > 0, "partial_pages")
        .otherwise("clean")
    )
