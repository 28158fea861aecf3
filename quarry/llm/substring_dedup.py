"""Exact substring deduplication: seeds on winnowed anchors, extended over the words around them.

A window is ``WINDOW`` consecutive words. A word is removed if a window that
covers it occurs earlier: in a document with a smaller id, or earlier in the same
document.

Method. Of each window the ``ANCHOR``-word run with the least hash is its anchor
(the rightmost of equals), so equal windows have equal anchors at equal offsets
and about one word in seven begins one. First, only anchors are joined: each block
of documents sends its distinct ones, and those that occur twice are told to their
documents. Second, the occurrences of these anchors meet, each with the words
around it as far as its windows reach. A group of equal anchors is extended word
by word to the right and to the left and splits where the words differ, so all its
members are compared at once and never in pairs; two windows are equal if their
extensions to both sides agree. Consecutive matched windows of a document fuse
into its maximal repeats of at least ``WINDOW`` words.

Scale. A block extends its own occurrences before it sends any: what is matched in
the block is settled, and a passage that a third of all rows hold reaches the
others at most once from each block. An anchor with more than one in ``MOST_HOT``
of all occurrences is hot; there are fewer than ``MOST_HOT`` such, which are
broadcast, and their occurrences are dealt by whole windows instead of by anchor,
so that only equal windows share a group. The number of buckets follows the
session's shuffle width.

Anchors are compared by two 64-bit hashes, the words around them one by one by
64-bit hashes.

Defined cases: null or blank text has no words and loses none; null ids are
ordered last; rows that share an id but not the text are ordered by the text's
hash; repeated rows (same id and text) are one document and get equal results; of
equal windows (ties) the one at the least (id, start) stays; a very long text is
one row and is read whole; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, gram_hashes, id_or_last, mixed, partitions, ranges, rows_of, small_batches, stored, texts, word_hashes

WINDOW = 20
ANCHOR = 8
#: Words that a window may have on one side of its anchor.
REACH = WINDOW - ANCHOR
#: Windows of the documents that a block gathers before it settles and sends them.
BLOCK_WINDOWS = 2_500_000
LEAST_BUCKETS = 128
#: Anchors are hot above this number of occurrences and this share (one in MOST_HOT) of all.
HOT_LEAST, MOST_HOT = 1000, 200_000
#: Occurrences extended at a time in a bucket, in whole groups.
SLICE = 100_000
_ONE = np.uint64(1)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` consecutive hashes, the place of the least; the rightmost of equals."""
    m = len(grams) - width + 1
    if m <= 0:
        return np.empty(0, np.int64)
    # doubling: least over 1, 2, 4 .. places, then two overlapping spans cover the width
    place, span = np.arange(len(grams)), 1
    while span * 2 <= width:
        a, b = place[: len(place) - span], place[span:]
        place = np.where(grams[b] <= grams[a], b, a)
        span *= 2
    a, b = place[:m], place[width - span : width - span + m]
    return np.where(grams[b] <= grams[a], b, a)


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's anchors: hash, place, and the least and most words that their windows have to the left."""
    grams = gram_hashes(words, ANCHOR)
    place = anchors(grams, REACH + 1)
    if not len(place):
        return np.empty(0, np.uint64), place, place, place
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[begin]
    return grams[at], at, at - np.append(begin[1:], len(place)) + 1, at - begin


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


def _refined(groups: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of each (group, word) among those that several members share; -1 for the others."""
    out = np.full(len(groups), -1, np.int32)
    if not len(groups):
        return out
    order = np.argsort(mixed(words + groups.astype(np.uint64) * _OTHER), kind="stable")
    g, w = groups[order], words[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])), len(g))
    size = np.diff(edges)
    number = np.where(size > 1, np.arange(len(size)), -1).astype(np.int32)
    out[order] = np.repeat(number, size)
    return out


def _grown(groups: np.ndarray, words: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
    """The groups after 0, 1 .. REACH more words; -1 once a member is alone or at the end of its reach."""
    out, active = [groups], np.flatnonzero(groups >= 0)
    for k in range(REACH):
        active = active[reach[active] > k]
        made = _refined(out[-1][active], words[active, k])
        active, made = active[made >= 0], made[made >= 0]
        after = np.full(len(groups), -1, np.int32)
        after[active] = made
        out.append(after)
    return out


def extended(groups: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that occur earlier in a group: (occurrence, words left of its anchor).

    ``left`` and ``right`` have the words beside each anchor, the nearest first.
    """
    rights, lefts = _grown(groups, right, REACH - low), _grown(groups, left, high)
    who, where = [], []
    for k in range(REACH + 1):
        own = np.flatnonzero((low <= k) & (k <= high) & (lefts[k] >= 0) & (rights[REACH - k] >= 0))
        if not len(own):
            continue
        key = lefts[k][own].astype(np.int64) << 32 | rights[REACH - k][own]
        order = np.lexsort((at[own], key))
        own, key = own[order], key[order]
        edges = _edges(key)
        least = np.repeat(at[own[edges[:-1]]], np.diff(edges))
        later = own[at[own] > least]
        who.append(later)
        where.append(np.full(len(later), k, np.int64))
    return (np.concatenate(who), np.concatenate(where)) if who else (np.empty(0, np.int64), np.empty(0, np.int64))


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every (doc, version), equal ones alike, and the distinct ones in order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    sorted_ = ids[order]
    fresh = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, sorted_[fresh]


def _packed(ids: np.ndarray, owner: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Rows sorted by owner as bytes: the documents, how many rows each has, and the columns."""
    edges = _edges(owner)
    head = ids[owner[edges[:-1]]].astype("<i8")
    sizes = np.array([len(head), len(owner)], "<i4")
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (sizes, head, np.diff(edges).astype("<i4"), *columns))


def _unpacked(blobs: list[bytes], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of all blobs: the documents' ids, each row's document, its columns, and the rests of the blobs as words."""
    heads, owners, columns, rests, base = [], [], [[] for _ in kinds], [], 0
    for b in blobs:
        docs, n = np.frombuffer(b, "<i4", 2).tolist()
        heads.append(np.frombuffer(b, "<i8", 2 * docs, 8))
        at = 8 + 16 * docs
        owners.append(np.repeat(np.arange(base, base + docs), np.frombuffer(b, "<i4", docs, at)))
        at, base = at + 4 * docs, base + docs
        for out, kind in zip(columns, kinds):
            out.append(np.frombuffer(b, kind, n, at))
            at += out[-1].nbytes
        rests.append(np.frombuffer(b, "<u8", (len(b) - at) // 8, at))
    return np.concatenate(heads).reshape(-1, 2), np.concatenate(owners), [np.concatenate(c) for c in columns], rests


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted array with its rows."""
    edges = _edges(bucket)
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), slice(a, b)


def _by_doc(ids: np.ndarray, owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, version, values of its rows) for each run of an owner."""
    edges = _edges(owner)
    for a, b in zip(edges, edges[1:]):
        doc, version = ids[owner[a]].tolist()
        yield doc, version, values[a:b].astype("<i4").tobytes()


_ASKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("version", pa.int64()), ("found", pa.binary())])


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ASKED.names, r)) for r in rows], schema=_ASKED)


def _anchor_asks(buckets: int):
    """(doc, version, text) -> a block's distinct anchors by bucket; those that repeat in it go to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            docs = np.array(ids, np.int64)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            number = np.concatenate([np.arange(len(p)) for p in parts])
            anchor = np.concatenate(parts)
            order = np.argsort(anchor, kind="stable")
            edges = _edges(anchor[order])
            size = np.diff(edges)
            first = order[edges[:-1]]
            again = np.sort(order[np.repeat(size > 1, size)])
            rows = [(k % buckets, None, *found) for k, found in enumerate(_by_doc(docs, owner[again], number[again]))]
            bucket = (anchor[first] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((first, bucket))
            bucket, first, size = bucket[order], first[order], size[order]
            for k, own in _by_bucket(bucket):
                f = first[own]
                rows.append((k, _packed(docs, owner[f], [number[f].astype("<i4"), size[own].astype("<u4"), anchor[f]]), None, None, None))
            ids.clear()
            parts.clear()
            yield _asked(rows)

        for batch in rows_of(batches):
            for doc, version, words in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(), word_hashes(texts(batch.column("text")))):
                if len(words) >= WINDOW:
                    ids.append((doc, version))
                    parts.append(seeds(words)[0])
                    held += len(words) - WINDOW + 1
                if held > BLOCK_WINDOWS:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


_TOLD = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("found", pa.binary()), ("anchor", pa.int64()), ("n", pa.int64())])


def _told(hot_least: int):
    """A bucket's anchors -> (doc, version, found) numbers of those that repeat; (anchor, n) of frequent ones; n of all."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        passed = table.filter(table.column("found").is_valid()).select(["doc", "version", "found"])
        blobs = [b for b in table.column("blob").to_pylist() if b is not None]
        rows: list[tuple] = []
        if blobs:
            ids, owner, (number, size, anchor), _ = _unpacked(blobs, ["<i4", "<u4", "<u8"])
            order = np.argsort(anchor, kind="stable")
            edges = _edges(anchor[order])
            asks = np.diff(edges)
            total = np.add.reduceat(size[order].astype(np.int64), edges[:-1])
            # a block has told its own anchors that repeat in it
            found = np.sort(order[np.repeat(asks > 1, asks) & (size[order] == 1)])
            rows += [(*x, None, None) for x in _by_doc(ids, owner[found], number[found])]
            heads = anchor[order[edges[:-1]]].view(np.int64)
            rows += [(None, None, None, int(heads[k]), int(total[k])) for k in np.flatnonzero(total >= hot_least)]
            rows.append((None, None, None, None, int(total.sum())))
        made = pa.Table.from_pylist([dict(zip(_TOLD.names, r)) for r in rows], schema=_TOLD)
        nothing = [pa.nulls(len(passed), pa.int64())] * 2
        return pa.concat_tables([pa.table([*passed.columns, *nothing], names=_TOLD.names).cast(_TOLD), made])

    return run


class Block:
    """Occurrences of repeated anchors in a number of documents, with the documents' words."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []
        self.docs: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.windows = 0

    def add(self, doc: int, version: int, words: np.ndarray, numbers: np.ndarray) -> None:
        anchor, place, low, high = (x[numbers] for x in seeds(words))
        check = gram_hashes(mixed(words ^ _OTHER), ANCHOR)[place]
        self.parts.append((anchor, check, place, low, high, np.full(len(place), len(self.docs)), place + self.held))
        self.docs.append((doc, version))
        self.words.append(words)
        self.held += len(words)
        self.windows += max(0, len(words) - WINDOW + 1)

    def settle(self, hot: np.ndarray, buckets: int) -> list[tuple]:
        """Rows of the block: windows that it has matched, and by bucket the occurrences that it has not."""
        anchor, check, place, low, high, doc, spot = (np.concatenate(x) for x in zip(*self.parts))
        words = np.concatenate(self.words)
        rank, ids = _ranked(np.array(self.docs, np.int64))
        doc = rank[doc]
        at = doc.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        group = _refined(_refined(np.zeros(len(anchor), np.int32), anchor), check)
        own = np.flatnonzero(group >= 0)
        who, where = extended(group[own], *_around(words, spot[own], low[own], high[own]), low[own], high[own], at[own])
        who = own[who]
        rows = [(k % buckets, None, *found) for k, found in enumerate(_spans_by_doc(ids, doc[who], place[who] - where))]
        open_ = np.ones((len(anchor), REACH + 1), bool)
        open_[who, where] = False
        width = np.arange(REACH + 1)
        open_ &= (low[:, None] <= width) & (width <= high[:, None])
        left = np.flatnonzero(open_.any(axis=1))
        is_hot = np.isin(anchor[left], hot)
        usual, hot_ones = left[~is_hot], left[is_hot]
        # a hot anchor's open windows go each for itself, dealt by their words
        each, at_word = np.nonzero(open_[hot_ones])
        each = hot_ones[each]
        start = spot[each] - at_word
        total = np.zeros(len(each), np.uint64)
        for k in range(WINDOW):
            total = mixed(total + words[start + k])
        pick = np.concatenate([usual, each])
        low, high = np.concatenate([low[usual], at_word]), np.concatenate([high[usual], at_word])
        bucket = (np.concatenate([anchor[usual], total]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at[pick], bucket))
        pick, low, high, bucket = pick[order], low[order], high[order], bucket[order]
        for k, part in _by_bucket(bucket):
            p, lo, hi = pick[part], low[part], high[part]
            columns = [place[p].astype("<i4"), lo.astype("<i1"), hi.astype("<i1"), anchor[p], check[p]]
            lefts, rights = _around(words, spot[p], lo, hi)
            n = np.arange(REACH)
            flat = np.concatenate([lefts, rights], axis=1)[np.concatenate([n < hi[:, None], n < REACH - lo[:, None]], axis=1)]
            rows.append((k, _packed(ids, doc[p], [*columns, flat]), None, None, None))
        return rows


def _around(words: np.ndarray, spot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words left and right of anchors, the nearest first, as far as their windows reach; 0 beyond."""
    k, last = np.arange(REACH), max(len(words) - 1, 0)
    left = np.where(k < high[:, None], words[np.maximum(spot[:, None] - 1 - k, 0)], np.uint64(0))
    right = np.where(k < REACH - low[:, None], words[np.minimum(spot[:, None] + ANCHOR + k, last)], np.uint64(0))
    return left, right


def _spans_by_doc(ids: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, version, pairs of a start and a number of consecutive windows) of matched windows."""
    at = np.unique(doc.astype(np.uint64) << np.uint64(32) | start.astype(np.uint64))
    if not len(at):
        return
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + _ONE]))
    count = np.diff(np.append(edge, len(at)))
    begin = at[edge]
    owner = (begin >> np.uint64(32)).astype(np.int64)
    pairs = np.stack([(begin & np.uint64(0xFFFFFFFF)).astype(np.int64), count], axis=1)
    yield from _by_doc(ids, owner, pairs)


def _occurrences(buckets: int, hot):
    """(doc, version, text, found) -> the rows of settled blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in rows_of(batches):
            hashes = word_hashes(texts(batch.column("text")))
            for doc, version, words, found in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(), hashes, batch.column("found").to_pylist()):
                block.add(doc, version, words, np.unique(np.frombuffer(b"".join(found), "<i4")))
                if block.windows > BLOCK_WINDOWS:
                    yield _asked(block.settle(hot.value, buckets))
                    block = Block()
        if block.docs:
            yield _asked(block.settle(hot.value, buckets))

    return run


def _extended(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's occurrences -> (doc, version, spans) of the windows that occur earlier. Settled ones pass through."""
    schema = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("spans", pa.binary())])
    settled = table.filter(table.column("found").is_valid()).select(["doc", "version", "found"]).rename_columns(schema.names).cast(schema)
    blobs = [b for b in table.column("blob").to_pylist() if b is not None]
    if not blobs:
        return settled
    ids, owner, (place, low, high, anchor, check), rests = _unpacked(blobs, ["<i4", "<i1", "<i1", "<u8", "<u8"])
    flat = np.concatenate([*rests, np.zeros(2 * REACH, np.uint64)])
    del blobs, rests
    place, low, high = place.astype(np.int64), low.astype(np.int64), high.astype(np.int64)
    size = high + REACH - low
    begin = np.cumsum(size) - size
    rank, ids = _ranked(ids)
    doc = rank[owner]
    at = doc.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
    group = _refined(_refined(np.zeros(len(anchor), np.int32), anchor), check)
    order = np.argsort(group, kind="stable")
    order = order[np.searchsorted(group[order], 0) :]
    edges = _edges(group[order])
    whos, starts, a = [], [], 0
    k = np.arange(REACH)
    while a < len(edges) - 1:
        # whole groups up to a slice, one at least
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + SLICE, "right")) - 1)
        own = order[edges[a] : edges[b]]
        lo, hi, first = low[own], high[own], begin[own]
        left = np.where(k < hi[:, None], flat[first[:, None] + k], np.uint64(0))
        right = np.where(k < REACH - lo[:, None], flat[(first + hi)[:, None] + k], np.uint64(0))
        who, where = extended(group[own], left, right, lo, hi, at[own])
        whos.append(doc[own[who]])
        starts.append(place[own[who]] - where)
        a = b
    found = list(_spans_by_doc(ids, np.concatenate(whos), np.concatenate(starts))) if whos else []
    return pa.concat_tables([settled, pa.Table.from_pylist([dict(zip(schema.names, r)) for r in found], schema=schema)])


def _versioned(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(id_or_last(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, version, spans): starts and numbers of windows that occur earlier, as pairs of 32-bit numbers."""
    spark = df.sparkSession
    small_batches(spark)
    buckets = max(LEAST_BUCKETS, 2 * partitions(spark))
    docs = _versioned(df, text_col, id_col)
    asked = "bucket int, blob binary, doc long, version long, found binary"
    told = docs.mapInArrow(_anchor_asks(buckets), asked).groupBy("bucket").applyInArrow(_told(HOT_LEAST), "doc long, version long, found binary, anchor long, n long")
    told = stored(told)
    total = told.where("doc is null and anchor is null").agg(F.sum("n").alias("x")).collect()[0]["x"] or 0
    # fewer than MOST_HOT: each has more than that share of all occurrences
    hot = told.where(F.col("anchor").isNotNull() & (F.col("n") * MOST_HOT > total)).select("anchor").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot.column("anchor").to_numpy()).view(np.uint64))
    found = told.where("doc is not null").groupBy("doc", "version").agg(F.collect_list("found").alias("found"))
    met = docs.join(found, ["doc", "version"]).select("doc", "version", "text", "found")
    return met.mapInArrow(_occurrences(buckets, hot), asked).groupBy("bucket").applyInArrow(_extended, "doc long, version long, spans binary")


def covered_words(n_words: int, spans: bytes) -> np.ndarray:
    """True for each word that a window of the spans covers."""
    pairs = np.frombuffer(spans, "<i4").reshape(-1, 2).astype(np.int64)
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] + WINDOW - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, removed, digest, kept_text, repeats_ = [], [], [], [], []
            for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                gone, runs = 0, []
                if spans:
                    cover = covered_words(len(words), b"".join(spans))
                    gone = int(cover.sum())
                    edges = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    runs = [(int(a), int(b - a)) for a, b in edges]
                    kept = [w for w, c in zip(words, cover.tolist()) if not c]
                else:
                    kept = words
                joined = b" ".join(kept)
                n.append(len(words))
                removed.append(gone)
                digest.append(hashlib.sha256(joined).hexdigest())
                repeats_.append([{"start": a, "words": m} for a, m in runs])
                kept_text.append(joined.decode("utf-8", "replace") if with_text else None)
            ids = pa.array([None if x == LAST_ID else x for x in batch.column("doc").to_pylist()], pa.int64())
            cols = [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(repeats_, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"]
            if with_text:
                cols, names = [*cols, pa.array(kept_text, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_text: bool = True) -> DataFrame:
    """One row for each row: doc_id, n_words, n_removed, kept_sha256, repeats (start, words), kept_text."""
    docs = _versioned(df, text_col, id_col)
    spans = repeats(df, text_col, id_col).groupBy("doc", "version").agg(F.collect_list("spans").alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,words:int>>"
    joined = docs.join(spans, ["doc", "version"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(_cut(with_text), schema + ", kept_text string" * with_text)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, with_text=False)


__all__ = ["WINDOW", "anchors", "seeds", "extended", "covered_words", "repeats", "substring_dedup", "op9_substring_dedup"]
