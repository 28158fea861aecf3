"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles (lower-cased A-Z). Two
documents link when 100 * |intersection| >= 80 * |union|; the operator returns for
every document the smallest id that it reaches over links.

Method. All shingles have one global order, from rare to frequent. If two sets
have the required overlap t, then of the first |set| - t + k shingles of each they
share at least k. Each document chooses its own k: a longer prefix costs more
postings but candidates must then share k of them, so k minimises
postings * (1 + verification / k), with the postings estimated from a frequency
sketch. A pair uses the smaller k of the two and only counts shared shingles that
can still be among the first k common ones.

Scale. Documents with equal sets are one class; only classes are compared. The
sketch has a fixed size and counts every shingle of every document; errors in it
change costs, never results. Prefixes travel as packed blocks by shingle. Each
shingle's postings are first paired with one leader only, the class with the
fewest rarer shingles, which a group of near copies shares; links found that way
form components. Then the pairs of postings in different components are generated
where the shared shingle can be the pair's first common one, so no link between
components is missed while pairs inside a component are never expanded.

Defined cases: null or blank text has no shingles and is linked with nothing (its
component is its own id); with fewer than five words the whole sequence is one
shingle; null ids count as larger than any id, and a component of null ids only
has the id null; repeated rows get the same result each; further columns are
ignored by ``near_duplicates`` and kept, whatever their names, by ``one_of_each``; of
equal ids (ties) the row with the least hash of its text stands for a component; a
very long text is one row with all its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    LAST_ID,
    SPACE_CHARS,
    dealt_join,
    distinct,
    gram_hashes,
    id_or_last,
    int64_lists,
    mixed,
    partitions,
    rows_of,
    small_batches,
    stored,
    texts,
    unused,
    word_hashes,
)
from .components import components

SHINGLE = 5
#: Similarity as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: The frequency sketch: rows, and counters in a row.
SKETCH_ROWS, SKETCH_WIDTH = 2, 1 << 20
SKETCH_PARTS = 8
#: The largest k, and the cost of verifying a shingle against that of a posting.
MOST_K, VERIFY = 16, 0.25
#: Postings of one shingle are dealt to several tasks from about this number on.
SPLIT_FROM = 17  # a power of two
#: Up to so many classes in candidate pairs, their ids are broadcast; beyond, joined by a shuffle.
MOST_BROADCAST = 200_000
#: Classes with more than this share (one in MOST_HOT) of all rows are told to every task.
MOST_HOT = 10_000
_HEAD = np.dtype([("token", "<u8"), ("cid", "<i8"), ("n", "<i4"), ("i", "<i4"), ("k", "<i1")])


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text with these word hashes."""
    if len(words) < SHINGLE:
        return gram_hashes(words, len(words)) ^ np.uint64(len(words)) if len(words) else words
    return distinct(gram_hashes(words, SHINGLE))


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [shingles(w) for w in word_hashes(texts(batch.column("text")), lower=True)]


def _places(sets: np.ndarray) -> list[np.ndarray]:
    """A counter in each row of the sketch: other bits of the hash for each row."""
    bits = int(SKETCH_WIDTH).bit_length() - 1
    return [((sets >> np.uint64(64 - (r + 1) * bits)) & np.uint64(SKETCH_WIDTH - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, print) -> (doc, n, key, cid, print), and at the end this task's part of the sketch."""
    counts = np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.int64)
    own = [("doc", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("cid", pa.int64()), ("print", pa.int64())]
    schema = pa.schema([*own, ("part", pa.int32()), ("counts", pa.binary())])
    for batch in rows_of(batches):
        sets = _sets_of(batch)
        for r, place in enumerate(_places(np.concatenate(sets))):
            counts[r] += np.bincount(place, minlength=SKETCH_WIDTH)
        n = [len(s) for s in sets]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        cids = [k and int.from_bytes(k[:8], "little", signed=True) for k in keys]
        nothing = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(cids, pa.int64()), batch.column("print"), *nothing], schema=schema)
    if counts.any():
        parts = np.split(counts.ravel().astype(np.uint32 if counts.max() < 2**32 else np.uint64), SKETCH_PARTS)
        packed = [bytes([p.itemsize]) + pa.compress(p.tobytes(), "zstd", asbytes=True) + len(p).to_bytes(4, "little") for p in parts]
        gone = (pa.nulls(len(parts), kind) for kind in schema.types[:-2])
        yield pa.RecordBatch.from_arrays([*gone, pa.array(range(len(parts)), pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def _unpacked(blob: bytes) -> np.ndarray:
    n, size = int.from_bytes(blob[-4:], "little"), blob[0]
    raw = pa.decompress(blob[1:-4], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{size}").astype(np.int64)


def _add_parts(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_ROWS * SKETCH_WIDTH // SKETCH_PARTS, np.int64)
    for blob in table.column("counts").to_pylist():
        total += _unpacked(blob)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(keys: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: a table of a fixed size."""
    parts = keys.where("part is not null").select("part", "counts").groupBy("part")
    rows = sorted(parts.applyInArrow(_add_parts, "part int, counts binary").collect())
    if not rows:
        return np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.int64)
    return np.concatenate([np.frombuffer(bytes(r["counts"]), np.int64) for r in rows]).reshape(SKETCH_ROWS, SKETCH_WIDTH)


def levels(sketch: np.ndarray) -> np.ndarray:
    """For each counter, the logarithm of the frequency that it shows, from 1; 0 within one deviation of its row.

    A rare shingle that looks frequent in all rows only stands later in the order.
    """
    load = sketch.sum(axis=1, keepdims=True) / SKETCH_WIDTH
    over = sketch - load
    return np.where(over > np.sqrt(load) + 1, np.log2(np.maximum(over, 1)).astype(np.int64) + 1, 0).astype(np.uint8)


def level_of(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A shingle's level: the least over the rows of the table."""
    first, *rest = (table[r][place] for r, place in enumerate(_places(tokens)))
    for other in rest:
        first = np.minimum(first, other)
    return first.astype(np.uint64)


def required(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of n with any set it can link with."""
    return -(-NUM * n // DEN)


def prefix(tokens: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's prefix in the global order, and its k.

    A token is made of six bits for the logarithm of its frequency and 58 of its hash.
    """
    n = len(tokens)
    token = np.sort((level_of(tokens, table) << np.uint64(58)) | (tokens >> np.uint64(6)))
    t = int(required(n))
    most = min(MOST_K, t)
    # its own posting, and those of the others that have the token
    cost = np.cumsum(np.exp2((token[: n - t + most] >> np.uint64(58)).astype(np.float64)))
    ks = np.arange(1, most + 1)
    scanned = cost[n - t + ks - 1]
    k = int(ks[np.argmin(scanned * (1 + VERIFY * n / ks))])
    return token[: n - t + k], k


def _prefixes(shared, buckets: int):
    """(doc, text) -> packed prefix postings, one row for a bucket of tokens and a block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        block: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(block)
            block.clear()
            level = (rows["token"] >> np.uint64(58)).astype(np.int64)
            splits = np.left_shift(np.uint64(1), np.maximum(level - SPLIT_FROM, 0).astype(np.uint64))
            salt = rows["cid"].view(np.uint64) % splits
            bucket = (mixed(rows["token"] + salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            spans = [(a, b) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array([_columns(rows[a:b]) for a, b in spans], pa.binary())], names=["bucket", "rows"])

        held = 0
        for batch in rows_of(batches):
            for tokens in _sets_of(batch):
                if not len(tokens):
                    continue
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                if key in seen:
                    continue
                seen.add(key)
                first, k = prefix(tokens, table)
                rows = np.empty(len(first), _HEAD)
                rows["token"], rows["cid"], rows["n"], rows["k"] = first, int.from_bytes(key[:8], "little", signed=True), len(tokens), k
                rows["i"] = np.arange(len(first))
                block.append(rows)
                held += len(rows)
            if held > 1 << 20:
                yield from flush()
                held = 0
        if block:
            yield from flush()

    return run


def _columns(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in _HEAD.names)


def _rows(blobs: list[bytes]) -> np.ndarray:
    sizes = [len(b) // _HEAD.itemsize for b in blobs]
    out, at = np.empty(sum(sizes), _HEAD), 0
    for blob, m in zip(blobs, sizes):
        place = 0
        for c in _HEAD.names:
            kind = _HEAD[c]
            out[c][at : at + m] = np.frombuffer(blob, kind, m, place)
            place += m * kind.itemsize
        at += m
    return out


def _partnered(rows: np.ndarray) -> np.ndarray:
    """Which postings (sorted by token) have another of their token with a size they can link with.

    Postings of tokens that are dealt to several tasks all stay.
    """
    new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
    group = np.cumsum(new) - 1
    n, rest = rows["n"].astype(np.int64), (rows["n"] - rows["i"]).astype(np.int64)
    wide = int(n.max()) * 2 + 2
    sizes = np.sort(group * wide + n)
    low = -(-NUM * n // DEN)
    # rest >= overlap - k + 1, and overlap >= NUM * (n + other) / (NUM + DEN)
    high = np.minimum(DEN * n // NUM, (rest + rows["k"] - 1) * (NUM + DEN) // NUM - n)
    near = np.searchsorted(sizes, group * wide + np.minimum(high, wide - 1), "right") - np.searchsorted(sizes, group * wide + low)
    hot = (rows["token"] >> np.uint64(58)).astype(np.int64) > SPLIT_FROM
    return (near > (high >= n)) | hot


def _postings(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's postings of tokens that several classes have, each with its token's leader."""
    rows = _rows(table.column("rows").to_pylist())
    rows = rows[np.lexsort((rows["cid"], rows["i"], rows["token"]))]
    # a class met in several tasks is here several times, on neighbouring rows
    same = (rows["token"][1:] == rows["token"][:-1]) & (rows["cid"][1:] == rows["cid"][:-1])
    rows = rows[np.concatenate([[True], ~same])]
    rows = rows[_partnered(rows)]
    if not len(rows):
        return pa.table({c: pa.array([], kind) for c, kind in _POSTING_ARROW})
    start = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
    count = np.diff(np.append(start, len(rows)))
    hot = (rows["token"][start] >> np.uint64(58)).astype(np.int64) > SPLIT_FROM
    kept = np.repeat((count > 1) | hot, count)
    lead = rows[np.repeat(start, count)][kept]
    rows = rows[kept]
    return pa.table({
        "token": rows["token"].view(np.int64), "cid": rows["cid"], "n": rows["n"], "i": rows["i"], "k": rows["k"],
        "lcid": lead["cid"], "ln": lead["n"], "li": lead["i"], "lk": lead["k"],
    })


_POSTING_ARROW = [("token", "int64"), ("cid", "int64"), ("n", "int32"), ("i", "int32"), ("k", "int8"), ("lcid", "int64"), ("ln", "int32"), ("li", "int32"), ("lk", "int8")]
_POSTING = "token long, cid long, n int, i int, k byte, lcid long, ln int, li int, lk byte"


def _matches(n1, i1, n2, i2, k):
    """Whether a shared token can be among the first k common ones of a pair that links."""
    overlap = F.ceil((n1 + n2) * F.lit(NUM) / F.lit(NUM + DEN))
    sizes = (F.least(n1, n2) * DEN) >= (F.greatest(n1, n2) * NUM)
    return sizes & (F.least(n1 - i1, n2 - i2) >= overlap - k + 1)


def _candidates(pairs: DataFrame) -> DataFrame:
    """Rows (a, an, ak, b, bn, bk) for each shared token -> pairs that share enough of them."""
    counted = pairs.groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.first("an").alias("an"), F.first("bn").alias("bn"), F.min(F.least("ak", "bk")).alias("k")
    )
    return counted.where("shared >= k")


def _sharing(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """The pairs (a, b, an, bn) whose prefixes share as many tokens as the smaller k of the two.

    The pairs have a shared token that can be the first common one of a linked
    pair; only for them are the prefixes themselves compared.
    """
    own = postings.groupBy("cid").agg(F.collect_list("token").alias("x"), F.first("k").alias("k"))
    side = lambda p: own.select(F.col("cid").alias(p), F.col("x").alias(f"{p}x"), F.col("k").alias(f"{p}k"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("ax", "bx")) >= F.least("ak", "bk")).select("a", "b", "an", "bn")


def _sets(docs: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, tokens) of the classes in the pairs (a, b), one row for each.

    A class is told by the id and the print of one of its rows, since many rows may share
    an id or have none; rows that repeat both are the same class.
    """
    cids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    owners = keys.join(cids, "cid", "left_semi").groupBy("key").agg(F.min(F.struct("doc", "print")).alias("row"), F.first("cid").alias("cid"))
    owners = stored(owners.select("row.doc", "row.print", "cid"))
    few = owners.count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(owners) if few else owners, ["doc", "print"]).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in rows_of(batches):
            cid = batch.column("cid").to_pylist()
            first = [k for k, x in enumerate(cid) if not (x in seen or seen.add(x))]
            sets = [shingles(w) for w in word_hashes(texts(batch.column("text").take(first)), lower=True)]
            own = [int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) for s in sets]
            keep = [k for k, x in enumerate(own) if x == cid[first[k]]]
            yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in keep], pa.int64()), int64_lists([sets[k] for k in keep])], names=["cid", "tokens"])

    made = rows.mapInArrow(run, "cid long, tokens array<long>")
    return stored(made.groupBy("cid").agg(F.first("tokens").alias("tokens")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose sets reach the similarity, as edges."""
    left = pairs.select("a", "b", "an", "bn").join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("at")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("bt")), "b")
    inter = F.size(F.array_intersect("at", "bt"))
    linked = inter * (NUM + DEN) >= (F.col("an") + F.col("bn")) * NUM
    return both.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hot_leaders(postings: DataFrame) -> DataFrame:
    """Pairs of the leaders of a hot token's parts with the token's own leader."""
    hot = postings.where((F.shiftrightunsigned("token", 58) > SPLIT_FROM) & (F.col("cid") == F.col("lcid")))
    own = hot.groupBy("token").agg(F.min(F.struct("i", "cid", "n", "k")).alias("x"))
    return hot.select("token", "cid", "n", "i", "k").join(own, "token").select(
        "cid", "n", "i", "k", F.col("x.cid").alias("lcid"), F.col("x.n").alias("ln"), F.col("x.i").alias("li"), F.col("x.k").alias("lk")
    )


def links_and_keys(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Components over classes (node, label), and each row's class (doc, n, key, cid) with a print of its text."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(id_or_last(F.col(id_col)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("print", F.xxhash64("text"))
    made = stored(docs.mapInArrow(_keys, "doc long, n long, key binary, cid long, print long, part int, counts binary"))
    keys = made.where("part is null").drop("part", "counts")
    table = spark.sparkContext.broadcast(levels(_sketch(made)))
    buckets = 2 * partitions(spark)
    packed = docs.select("text").mapInArrow(_prefixes(table, buckets), "bucket int, rows binary")
    postings = stored(packed.groupBy("bucket").applyInArrow(_postings, _POSTING))

    c = F.col
    led = postings.select("cid", "n", "i", "k", "lcid", "ln", "li", "lk").unionByName(_hot_leaders(postings))
    led = led.where(c("cid") != c("lcid")).where(_matches(c("n"), c("i"), c("ln"), c("li"), F.least("k", "lk")))
    first = _candidates(led.select(c("lcid").alias("a"), c("ln").alias("an"), c("lk").alias("ak"), c("cid").alias("b"), c("n").alias("bn"), c("k").alias("bk")))
    best = first.groupBy("b").agg(F.max(F.struct("shared", "a", "an", "bn")).alias("x")).select("x.a", "b", "x.an", "x.bn")
    best = stored(best)
    found = stored(_verified(best, _sets(docs, keys, best)))
    labels = components(found)

    labelled = postings.select("token", "cid", "n", "i", "k").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "cid"))
    several = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    open_ = stored(labelled.join(several, "token"))
    usual = open_.groupBy("token", "label").count().groupBy("token").agg(F.max(F.struct("count", "label")).alias("x")).select("token", c("x.label").alias("usual"))
    rest = open_.join(usual, "token").where("label <> usual")
    as_ = lambda t, p: t.select("token", *[c(x).alias(p + x) for x in ("cid", "n", "i", "k", "label")])
    # a pair of two postings outside the usual component is met twice; the ids' order keeps one
    crossed = (
        as_(rest.withColumn("usual", F.lit(0)), "r")
        .join(as_(open_, "o").join(usual, "token"), "token")
        .where("rlabel <> olabel and (olabel = usual or rcid < ocid)")
        .where(_matches(c("rn"), c("ri"), c("on"), c("oi"), F.lit(1)))
    )
    first = crossed.select(
        F.least("rcid", "ocid").alias("a"), F.greatest("rcid", "ocid").alias("b"),
        F.when(c("rcid") < c("ocid"), c("rn")).otherwise(c("on")).alias("an"),
        F.when(c("rcid") < c("ocid"), c("on")).otherwise(c("rn")).alias("bn"),
    ).distinct()
    pairs = stored(_sharing(stored(first), open_))
    more = stored(_verified(pairs, _sets(docs, keys, pairs)))
    if not more.isEmpty():
        stars = labels.select(c("node").alias("u"), c("label").alias("v"))
        labels = components(stars.unionByName(more))
    return labels, keys


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_shingles, component_id, class_id.

    ``class_id`` is the smallest id with exactly the same shingles.
    """
    labels, keys = links_and_keys(df, text_col, id_col)
    classes = keys.where("key is not null").groupBy("key").agg(F.min("doc").alias("class_id"), F.first("cid").alias("cid"), F.count("*").alias("rows"))
    classes = stored(classes)
    linked = labels.withColumnRenamed("node", "cid").join(classes.select("cid", "class_id"), "cid")
    least = linked.groupBy("label").agg(F.min("class_id").alias("component_id"))
    own = dealt_join(linked, least, "label", "cid").select("cid", "component_id")
    ids = classes.join(own, "cid", "left").select("key", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "rows")
    # a class with many copies is one of at most MOST_HOT, which every task gets
    many = F.col("rows") * MOST_HOT > keys.count()
    hot = F.broadcast(stored(ids.where(many)).select("key", "class_id", "component_id"))
    worded, blank = keys.where("key is not null"), keys.where("key is null")
    back = lambda x: F.nullif(F.coalesce(F.col(x), F.col("doc")), F.lit(LAST_ID))
    out = [F.nullif("doc", F.lit(LAST_ID)).alias("doc_id"), F.col("n").alias("n_shingles")]
    placed = [worded.join(hot, "key"), worded.join(hot, "key", "left_anti").join(ids.where(~many).drop("rows"), "key")]
    found = placed[0].unionByName(placed[1]).select(*out, back("component_id").alias("component_id"), back("class_id").alias("class_id"))
    # blank texts are linked with nothing
    return found.unionByName(blank.select(*out, F.nullif("doc", F.lit(LAST_ID)).alias("component_id"), F.nullif("doc", F.lit(LAST_ID)).alias("class_id")))


def one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, that with the smallest id, with the input's columns.

    A row is told by its id and its text: an id that comes with texts of several
    components stays in each where it is the smallest, and of rows that repeat both
    one stays. Rows with a null id stay only where their component has no other id,
    one for each component. Blank texts are linked with nothing: one stays for each
    id, and all that have none.
    """
    labels, keys = links_and_keys(df, text_col, id_col)
    classes = keys.where("key is not null").groupBy("key").agg(F.min(F.struct("doc", "print")).alias("row"), F.first("cid").alias("cid"))
    labelled = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = labelled.groupBy("label").agg(F.min("row").alias("row")).select("row.doc", "row.print")
    blanks = keys.where("key is null").where(F.col("doc") < LAST_ID).groupBy("doc").agg(F.min("print").alias("print"))
    doc, text = id_or_last(F.col(id_col)), F.col(text_col).cast("string")
    own = [unused(x, df.columns) for x in ("_doc", "_print")]
    rows = df.withColumns(dict(zip(own, (doc, F.xxhash64(text)))))
    kept = rows.join(least.unionByName(blanks).toDF(*own), own, "left_semi").dropDuplicates(own).drop(*own)
    blank = F.coalesce(F.btrim(text, F.lit(SPACE_CHARS)), F.lit("")) == ""
    return kept.unionByName(df.where((doc == LAST_ID) & blank))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-duplicate components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "class_id")


__all__ = ["near_duplicates", "one_of_each", "links_and_keys", "op1_ngram_jaccard", "shingles", "prefix"]
