"""Pages to chunks: splitting, greedy packing and merging, gaps, grouping."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import rules
from ..functions import text as T


def hard_slices(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, stripped, without empty ones."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.filter(F.transform(pieces, T.strip), lambda x: x != "")


def packed(blocks: Column, size: int, joiner: str = "\n\n") -> Column:
    """Greedy packing of blocks up to ``size`` characters; larger blocks are sliced."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, block: Column) -> Column:
        joined = F.when(state["open"] == "", block).otherwise(F.concat(state["open"], F.lit(joiner), block))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return (
            F.when(F.char_length(joined) <= size, F.struct(state["done"].alias("done"), joined.alias("open")))
            .when(F.char_length(block) <= size, F.struct(closed.alias("done"), block.alias("open")))
            .otherwise(F.struct(F.concat(closed, hard_slices(block, size)).alias("done"), F.lit("").alias("open")))
        )

    return F.aggregate(blocks, empty, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def packed_blocks(blocks: list[str], size: int, joiner: str = "\n\n") -> list[str]:
    """``packed`` of a Python list, in one pass over the blocks."""
    done: list[str] = []
    held: list[str] = []
    length = 0
    for block in blocks:
        if held and length + len(joiner) + len(block) <= size:
            held.append(block)
            length += len(joiner) + len(block)
            continue
        if held:
            done.append(joiner.join(held))
        held, length = ([block], len(block)) if len(block) <= size else ([], 0)
        if not held:
            done += [piece for k in range(0, len(block), size) if (piece := block[k : k + size].strip())]
    return [*done, joiner.join(held)] if held else done


# The two functions below go through whole documents. An Arrow batch holds 10,000 of them however long they are, so
# they take rows, of which Spark sends about a hundred at a time.
def _packing(size: int, joiner: str = "\n\n"):
    """``packed`` of blocks, row by row, and whether to pack them."""

    def pack(blocks: list[str] | None, wanted: bool | None) -> list[str] | None:
        return packed_blocks(blocks, size, joiner) if blocks is not None and wanted else blocks

    return F.udf(pack, ArrayType(StringType()), useArrow=False)


def _blocks(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), T.strip), lambda x: x != "")


def split_large(text: Column, size: int = rules.MAX_CHUNK_CHARS) -> Column:
    """A text's pieces: itself, or packed paragraphs, or packed sentences, or slices."""

    own = T.strip(text)
    paragraphs, sentences = _blocks(own, r"\n{2,}"), _blocks(own, r"(?U)(?<=[.!?؟؛:])\s+")
    whole = F.char_length(own) <= size
    cut = F.when(whole, F.array(own)).otherwise(
        T.let(paragraphs, lambda p: F.when(F.size(p) > 1, p).otherwise(T.let(sentences, lambda x: F.when(F.size(x) > 1, x).otherwise(hard_slices(own, size)))))
    )
    return _packing(size)(cut, ~whole)


def plain_entries(text: Column, size: int = rules.PLAIN_ENTRY_CHARS) -> Column:
    """Pseudo-pages of a plain text: paragraphs packed up to ``size``."""
    return _packing(size)(_blocks(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n"), F.lit(True))


def embedded_pages(text: Column, fallback: Column) -> Column:
    """Pieces (page, text) of a text with ``Page N`` banners; what stands before has the fallback's label."""
    banner = r"(?iU)[—-]?\s*Page\s+(\d+)\s*[—-]?"
    labels = F.concat(F.array(fallback.cast("string")), F.regexp_extract_all(text, F.lit(banner), F.lit(1)))
    pieces = F.transform(F.split(text, banner), T.strip)
    pairs = F.zip_with(labels, pieces, lambda p, t: F.struct(p.alias("page"), T.strip(F.regexp_replace(t, F.concat(F.lit(r"(?iU)^\s*P\s*"), p, F.lit(r"\b")), F.lit(""))).alias("text")))
    kept = F.filter(pairs, lambda x: x["text"] != "")
    whole = F.array(F.struct(fallback.cast("string").alias("page"), text.alias("text")))
    return F.when((F.size(labels) > 1) & (F.size(kept) > 0), kept).otherwise(whole)


def merged(entries: Column, target: int = rules.MERGE_TARGET_CHARS, most: int = rules.MAX_CHUNK_CHARS) -> Column:
    """Neighbouring entries (page, text) of one page joined while one side is short and both fit."""
    start = F.filter(entries, lambda x: F.lit(False))

    def step(done: Column, entry: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        a, b = F.char_length(last["text"]), F.char_length(entry["text"])
        fits = (last["page"] == entry["page"]) & (a + b + 2 <= most) & ((a < target) | (b < target))
        both = F.struct(last["page"].alias("page"), F.concat(last["text"], F.lit("\n"), entry["text"]).alias("text"))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(fits, F.lit(False)), F.array_append(head, both)).otherwise(F.array_append(done, entry))

    return F.aggregate(entries, start, step)


def _merging(target: int = rules.MERGE_TARGET_CHARS, most: int = rules.MAX_CHUNK_CHARS):
    """``merged`` of (pages, texts), row by row, in one pass over a document's entries."""

    def merge(pages: list[str | None], texts: list[str]) -> tuple[list[str | None], list[str]]:
        labels: list = []
        parts: list[list[str]] = []
        length = 0
        for page, text in zip(pages, texts):
            n = len(text)
            if labels and page is not None and labels[-1] == page and length + n + 2 <= most and (length < target or n < target):
                parts[-1].append(text)
                length += 1 + n
            else:
                labels.append(page)
                parts.append([text])
                length = n
        return labels, ["\n".join(p) for p in parts]

    return F.udf(merge, StructType([StructField("pages", ArrayType(StringType())), StructField("texts", ArrayType(StringType()))]), useArrow=False)


def chunks(entries: DataFrame, size: int = rules.MAX_CHUNK_CHARS, least: int = rules.MIN_USEFUL_CHARS) -> DataFrame:
    """Entries (doc_id, page_seq, page, text) -> chunks with running index and id.

    Entries of a document are collected in order, as merging depends on what was
    merged before; a document is the unit of work.
    """
    listed = entries.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_seq", "page", "text"))).alias("_e"))
    plain = listed.select("doc_id", _merging()(F.col("_e.page").cast("array<string>"), F.col("_e.text")).alias("_m"))
    pieces = plain.select("doc_id", F.posexplode(F.arrays_zip("_m.pages", "_m.texts")).alias("_i", "_x"))
    pieces = pieces.select("doc_id", "_i", F.col("_x.pages").alias("page"), split_large(F.col("_x.texts"), size).alias("_s"))
    pieces = pieces.select("doc_id", "_i", "page", F.posexplode("_s").alias("_j", "_t"))
    cleaned = pieces.withColumn("text", T.clean_text(F.col("_t"))).where((F.char_length("text") >= least) & ~T.is_noise(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("_i", "_j")
    numbered = cleaned.withColumn("chunk_index", F.row_number().over(order) - 1)
    return numbered.select("doc_id", "chunk_index", F.concat(F.col("doc_id").cast("string"), F.lit("_c"), "chunk_index").alias("id"), "page", "text", T.detect_section(F.col("text")).alias("section"))


def page_gaps(pages: DataFrame, key: str, number: str, expected: str | None = None) -> DataFrame:
    """Missing pages of each key as ranges, from 1 to the greatest observed or expected."""
    last = F.max(number) if expected is None else F.greatest(F.max(number), F.coalesce(F.max(expected), F.lit(0)))
    own = pages.where(F.col(number).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(number)).alias("_p"), last.alias("_last"))
    # each page with the one before, the end of the document behind the last
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0)), "_p").alias("before"), F.concat("_p", F.array(F.col("_last") + 1)).alias("after"))
    found = F.filter(pairs, lambda g: g["after"] - g["before"] > 1)
    own = own.select(key, F.transform(found, lambda g: F.struct((g["before"] + 1).alias("a"), (g["after"] - 1).alias("b"))).alias("_g"))
    shown = F.transform("_g", lambda g: F.when(g["a"] == g["b"], g["a"].cast("string")).otherwise(F.concat_ws("-", g["a"], g["b"])))
    total = F.aggregate("_g", F.lit(0), lambda n, g: n + (g["b"] - g["a"] + 1).cast("int"))
    return own.select(key, F.array_join(shown, ",").alias("missing"), total.alias("n_missing"))


def grouped_pages(rows: DataFrame, by: list[str], order: list[str], text: str = "text", joiner: str = "\n") -> DataFrame:
    """Texts of a group joined in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[text]), joiner).alias(text))


def offsets(pages: DataFrame, by: str, order: str, text: str = "text", gap: int = 2) -> DataFrame:
    """Start and end of each page in its document's joined text."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length(text) + gap).over(before), F.lit(0))
    return pages.withColumn("start", start).withColumn("end", F.col("start") + F.char_length(text))


def articles(text: Column) -> Column:
    """Pieces of a text that begin at ``ARTICLE n``."""
    cut = F.when(F.contains(F.lower(text), F.lit("article")), F.split(text, r"(?i)(?=\bARTICLE\s+\d{1,3}\b)")).otherwise(F.array(text))
    return F.filter(F.transform(cut, T.strip), lambda x: x != "")


_ARTICLE = re.compile(r"(?i)(?=\bARTICLE[ \t\n\x0b\f\r]+[0-9]{1,3}\b)")
_SENTENCE = re.compile(r"(?<=[.!?:;])[ \t\n\x0b\f\r]+")
#: A name of this module's own, since functions that go to workers take whole modules with them.
_WHITE = T.WHITE


def passages_of(text: str, most: int = rules.PASSAGE_CHARS, target: int = rules.PASSAGE_TARGET) -> list[str]:
    """A text's articles; those longer than ``most`` packed by sentences."""
    cut = _ARTICLE.split(text) if "article" in text.lower() else [text]
    out: list[str] = []
    for own in filter(None, (x.strip(_WHITE) for x in cut)):
        if len(own) <= most:
            out.append(own)
        else:
            out += packed_blocks([x for x in (b.strip(_WHITE) for b in _SENTENCE.split(own)) if x], target, " ")
    return out


def passages(text: Column, most: int = rules.PASSAGE_CHARS, target: int = rules.PASSAGE_TARGET) -> Column:
    """``passages_of`` in Arrow batches; null for a null text."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else passages_of(x, most, target))

    return cut(text)


def listed_items(segment: Column, most: int = 12) -> Column:
    """Items of a list that begin with a number, a letter or a bullet; distinct, at most ``most``."""
    items = F.transform(F.split(segment, r"(?m)(?:^|\n)\s*(?:\d{1,2}[.)-]|[a-z]\)|[-•*])\s+"), T.compact)
    return F.slice(F.array_distinct(F.filter(items, lambda x: x != "")), 1, most)


def quality_metadata(pages: DataFrame, by: str, order: str, number: str, text: str = "text") -> DataFrame:
    """Per document: gaps, Arabic and readable shares, and the mode that follows from them."""
    joined = grouped_pages(pages, [by], [order], text)
    gaps = page_gaps(pages, by, number)
    arabic, readable = F.round(T.arabic_ratio(F.col(text)), 4), F.round(T.readable_ratio(F.col(text)), 4)
    rows = joined.join(gaps, by, "left").select(by, arabic.alias("arabic_ratio"), readable.alias("readable_ratio"), F.coalesce("n_missing", F.lit(0)).alias("page_gap_count"), F.coalesce("missing", F.lit("")).alias("missing"))
    mode = (
        F.when((F.col("arabic_ratio") >= rules.ARABIC_LEAST) & ((F.col("readable_ratio") < rules.ARABIC_READABLE) | (F.col("page_gap_count") > 0)), "arabic_noisy")
        .when(F.col("readable_ratio") < rules.READABLE_LEAST, "noisy_ocr")
        .when(F.col("page_gap_count") > 0, "partial_pages")
        .otherwise("clean")
    )
    return rows.withColumn("mode", mode)
