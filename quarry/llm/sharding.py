"""Sharding by histogram sort, in Spark's own expressions only.

Documents are ordered by (hash of the text, hash of the id), so that equal texts
lie together and yet a text that a third of all rows share can be cut. Splitters
between the shards are found by counting: every round counts the exact bytes
below candidate boundaries in all partitions, keeps for each target the interval
that holds it, and probes that interval more finely, until each splitter is
within the tolerance or its interval is a single key. Only then do rows move,
once.

Slots are numbered inside cells of a shard, each of about ``CELL_ROWS`` rows whatever
the table's size: the cells are ranges of the text's hash, as many as the rows ask
for, and a range with many more rows, as a text that a third of all rows share
makes it, is dealt further by the id's hash. A table of the cells' sizes gives every
cell its first slot.

Defined cases: a null text counts 8 bytes and has the CRC of the empty text; a
null id is hashed like a value; repeated rows have equal keys (ties) and are never
separated by a splitter; a very long text is a row like any other, and a shard is
near equal as far as whole rows allow; an empty table gives an empty result; columns
of the input named ``shard`` or ``slot`` are refused, or replaced with ``replace``;
no other column clashes.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

SHARDS = 24
#: Bytes a splitter may be off, as a share of one shard's mean.
TOLERANCE = 0.0005
#: Bits that each round adds to the probes: first, later.
FIRST_BITS, NEXT_BITS = 12, 8
#: Rows of a cell in which slots are numbered, and the least and most bits of the text's hash that make one.
CELL_ROWS, CELL_BITS, MOST_CELL_BITS = 100_000, 4, 16
OUT = ("shard", "slot")


def key_columns(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """The two 64-bit parts of a document's key; both are compared as signed numbers."""
    return F.xxhash64(text), F.xxhash64(doc_id)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _prefix(bits: int) -> list[Column]:
    """The key's first bits as columns; the order of prefixes is the order of keys."""
    if bits <= 64:
        return [F.shiftright("_h", 64 - bits)]
    return [F.col("_h"), F.shiftright("_e", 128 - bits)]


def _first_key(prefix: tuple, bits: int) -> tuple[int, int]:
    if bits <= 64:
        return prefix[0] << (64 - bits), -(2**63)
    return prefix[0], prefix[1] << (128 - bits)


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """First keys of the shards 1.. of a table of (_h, _e, _size)."""
    total = keys.agg(F.sum("_size").alias("x")).collect()[0]["x"] or 0
    if not total:
        return []
    targets = {i: total * i // shards for i in range(1, shards)}
    allowed = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # target -> (bytes below its interval, prefix of the interval)
    inside: dict[int, tuple[int, tuple]] = {i: (0, ()) for i in targets}
    bits = 0
    while inside:
        step = min(FIRST_BITS if not bits else NEXT_BITS, 128 - bits, 64 - bits if bits < 64 else 128)
        parents = sorted({p for _, p in inside.values()})
        rows = keys
        if bits:
            parent = F.struct(*[c.alias(f"p{k}") for k, c in enumerate(_prefix(bits))])
            rows = keys.where(parent.isin([F.struct(*[F.lit(x).alias(f"p{k}") for k, x in enumerate(p)]) for p in parents]) if len(_prefix(bits)) > 1 else _prefix(bits)[0].isin([p[0] for p in parents]))
        wide = bits + step
        named = [c.alias(f"c{k}") for k, c in enumerate(_prefix(wide))]
        # at most shards * 2**step rows: a fixed number
        counted = rows.groupBy(*named).agg(F.sum("_size").alias("n")).collect()
        cells = sorted((tuple(r[:-1]), r["n"]) for r in counted)
        under: dict[tuple, list[tuple[tuple, int]]] = {}
        for cell, n in cells:
            under.setdefault(_parent(cell, wide, bits), []).append((cell, n))
        after: dict[int, tuple[int, tuple]] = {}
        for i, (below, p) in inside.items():
            edge, own = below, under[p]
            for k, (cell, n) in enumerate(own):
                if edge + n >= targets[i] or k == len(own) - 1:
                    break
                edge += n
            if targets[i] - edge <= allowed:
                found[i] = _first_key(cell, wide)
            elif edge + n - targets[i] <= allowed and k + 1 < len(own):
                found[i] = _first_key(own[k + 1][0], wide)
            elif wide == 128:
                nearer_after = edge + n - targets[i] < targets[i] - edge
                found[i] = (cell[0], cell[1] + 1) if nearer_after and cell[1] < 2**63 - 1 else _first_key(cell, wide)
            else:
                after[i] = (edge, cell)
        inside, bits = after, wide
    return [found[i] for i in sorted(found)]


def _parent(cell: tuple, wide: int, bits: int) -> tuple:
    if not bits:
        return ()
    if wide <= 64:
        return (cell[0] >> (wide - bits),)
    return (cell[0],) if bits == 64 else (cell[0], cell[1] >> (wide - bits))


def shard_column(h: Column, e: Column, splits: list[tuple[int, int]]) -> Column:
    """The shard of a key by binary search, as one expression."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        split_h, split_e = splits[mid]
        left = (h < F.lit(split_h)) | ((h == F.lit(split_h)) & (e < F.lit(split_e)))
        return F.when(left, search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(splits)).cast("int")


def shard_of(key: tuple[int, int], splits: list[tuple[int, int]]) -> int:
    """The same for one key, in Python; for tests."""
    return bisect_right(splits, key)


def cell_bits(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Bits of the hash that make cells of about ``cell_rows`` rows."""
    return min(MOST_CELL_BITS, max(CELL_BITS, (-(-rows // cell_rows) - 1).bit_length()))


def shard_by_bytes(
    df: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, text_col: str = "text", id_col: str = "doc_id", replace: bool = False, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``df`` with ``shard`` (0..shards-1, near equal bytes) and ``slot`` (gapless from 0 in a shard)."""
    named = {c.lower() for c in df.columns}
    if clash := sorted(named & set(OUT)):
        if not replace:
            raise ValueError(f"columns {clash} are made here; rename those of the input")
    others = [c for c in df.columns if c.lower() not in OUT]
    h, e = key_columns(F.col(text_col), F.col(id_col))
    keys = checkpointed(df.select(h.alias("_h"), e.alias("_e"), size_of(F.col(text_col)).alias("_size")))
    shard = shard_column(F.col("_h"), F.col("_e"), splitters(keys, shards, tolerance))
    bits = cell_bits(keys.count(), cell_rows)
    spark, range_ = df.sparkSession, F.shiftrightunsigned("_h", 64 - bits)
    # at most 2**MOST_CELL_BITS rows
    sizes = keys.groupBy(range_.alias("r")).count().collect()
    wide = [(r["r"], (-(-r["count"] // cell_rows) - 1).bit_length()) for r in sizes if r["count"] > 2 * cell_rows]
    dealt = F.broadcast(spark.createDataFrame(wide, "_range long, _bits int"))

    def placed(rows: DataFrame) -> DataFrame:
        """With the shard and the cell: a range of the text's hash, and in a wide range a part by the id's hash."""
        part = F.when(F.col("_bits") > 0, F.expr("shiftrightunsigned(_e, 64 - _bits)")).otherwise(F.lit(0))
        met = rows.withColumns({"_shard": shard, "_range": range_}).join(dealt, "_range", "left")
        return met.withColumn("_part", part.cast("long")).drop("_bits")

    # bounded: the ranges, one more for each splitter, and the parts, one for each cell_rows rows
    counts = placed(keys).groupBy("_shard", "_range", "_part").agg(F.count("*").alias("_n")).collect()
    offsets, last, at = [], None, 0
    for r in sorted(counts):
        at = at if r["_shard"] == last else 0
        offsets.append((*r[:3], at))
        last, at = r["_shard"], at + r["_n"]
    first = spark.createDataFrame(offsets, "_shard int, _range long, _part long, _first long")
    # the input's columns travel in one, so that no name of theirs clashes
    rows = placed(df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), h.alias("_h"), e.alias("_e")))
    rows = rows.join(F.broadcast(first), ["_shard", "_range", "_part"])
    numbered = "row_number() OVER (PARTITION BY _shard, _range, _part ORDER BY _h, _e)"
    out = rows.select("_row", F.col("_shard").alias("shard"), (F.col("_first") + F.expr(numbered) - 1).alias("slot"))
    return out.select("_row.*", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_bytes(docs).select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
