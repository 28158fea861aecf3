"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and lose ASCII punctuation. A window of ``STRETCH`` words (or
of a shorter item's own length) that may lose e words is cut into e + 2 blocks; each
two blocks are a seed, whose hash looks at their words only. Any e substitutions
leave two blocks intact, so no window that counts as equal below is missed. The
seeds' hashes of all windows of the benchmark are joined with those of the documents.
Every hit gives a document, an item and their offset; along that offset the words
are compared, and the item counts as found if some stretch of ``STRETCH`` words (or
the whole item, if shorter) has at least ``SHARE`` of its words equal, whatever is
substituted in between. Items of at most four words can lose none.

The benchmark is broadcast as arrays in parts of at most ``MOST_WORDS`` words; a
larger one is joined part by part, each part over all documents.

Defined cases: null or blank text and items without words match nothing; null ids
are returned as null; repeated rows and repeated items match each for themselves;
an empty benchmark or table gives an empty result; further columns are kept by
``decontaminated`` and ignored by ``contaminations``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ODD, mixed, ranges, rows_of, small_batches, texts, word_hashes

STRETCH, SHARE = 13, 0.8
MOST_WORDS = 2_000_000
_TABLE_BITS = 22


_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_in(batch: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, lower-cased and without punctuation."""
    plain = [t.decode("utf-8", "replace").lower().encode().translate(None, _PUNCTUATION) for t in batch]
    return word_hashes(plain) if plain else []


def blocks_of(width: int) -> list[np.ndarray]:
    """The places of a window in two blocks more than it may lose words; one block if it may lose none."""
    lost = width - math.ceil(SHARE * width)
    return np.array_split(np.arange(width), lost + 2 if lost else 1)


def seed_hashes(words: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each seed, its hash of every window of ``width`` words."""
    m = len(words) - width + 1
    if m <= 0:
        return
    sums = []
    for block in blocks_of(width):
        total = np.zeros(m, np.uint64)
        for k in block.tolist():
            total += words[k : k + m] * _ODD[k]
        sums.append(total)
    seeds = [a + b for a, b in combinations(sums, 2)] or sums
    for j, total in enumerate(seeds):
        yield mixed(total + np.uint64(8 * width + j))


@dataclass
class Index:
    """The seeds of a part of the benchmark, sorted by hash."""

    ids: list
    words: np.ndarray
    begin: np.ndarray
    widths: list[int]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray

    def as_dict(self) -> dict:
        return self.__dict__


def index_of(ids: list, items: list[bytes]) -> Index:
    words = words_in(items)
    lengths = [len(w) for w in words]
    widths = sorted({min(STRETCH, n) for n in lengths if n})
    hashes, item, place = [], [], []
    for k, w in enumerate(words):
        for h in seed_hashes(w, min(STRETCH, len(w))) if len(w) else ():
            hashes.append(h)
            item.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    h, item, place = cat(hashes, np.uint64), cat(item, np.int32), cat(place, np.int32)
    order = np.argsort(h, kind="stable")
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(h & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return Index(ids, cat(words, np.uint64), np.cumsum([0, *lengths]), widths, h[order], item[order], place[order], table)


def found_in(words: np.ndarray, index: dict) -> list[tuple[int, int, int, int]]:
    """(item, first word, words equal, words compared) for each item found in a text, its best offset."""
    best: dict[int, tuple[int, int, int]] = {}
    seen: set[tuple[int, int]] = set()
    hashes, table = index["hashes"], index["table"]
    low = np.uint64(len(table) - 1)
    for h in (h for width in index["widths"] for h in seed_hashes(words, width)):
        at = np.flatnonzero(table[(h & low).astype(np.int64)])
        if not len(at):
            continue
        left, right = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        hit = ranges(left, right - left)
        offsets = np.repeat(at, right - left) - index["place"][hit]
        for item, offset in {*zip(index["item"][hit].tolist(), offsets.tolist())} - seen:
            seen.add((item, offset))
            a, b = index["begin"][item], index["begin"][item + 1]
            own = index["words"][a:b]
            first, last = max(0, offset), min(len(words), offset + len(own))
            equal = words[first:last] == own[first - offset : last - offset]
            width = min(STRETCH, len(own))
            if len(equal) < width:
                continue
            sums = np.cumsum(np.concatenate([[0], equal]))
            if (sums[width:] - sums[:-width]).max() >= SHARE * width:
                score = (int(equal.sum()), -first, len(equal))
                best[item] = max(best.get(item, score), score)
    return [(item, -start, equal, size) for item, (equal, start, size) in sorted(best.items())]


def _parts(bench: DataFrame, most_words: int) -> Iterator[Index]:
    """The benchmark in parts of about ``most_words`` words at most."""
    rows = bench.select(F.col("item_id").alias("id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("x")).collect()[0]["x"] or 0
    parts = -(-total // (4 * most_words)) or 1
    for k in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        table = own.toArrow()
        yield index_of(table.column("id").to_pylist(), texts(table.column("text")))


def contaminations(docs: DataFrame, bench: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id, start, matched, compared) for each document and item found in it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _parts(bench, most_words):
        shared = spark.sparkContext.broadcast(index.as_dict())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in rows_of(batches):
                found = [
                    (doc, index["ids"][item], start, equal, size)
                    for doc, words in zip(batch.column("doc_id").to_pylist(), words_in(texts(batch.column("text"))))
                    for item, start, equal, size in found_in(words, index)
                ]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "matched", "compared"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, start long, matched long, compared long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, bench: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents in which no item is found, with the input's columns."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _parts(bench, most_words):
        shared = spark.sparkContext.broadcast(index.as_dict())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches):
                words = words_in(texts(batch.column("text")))
                yield batch.filter(pa.array([not found_in(w, shared.value) for w in words]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
