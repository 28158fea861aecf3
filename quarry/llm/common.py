"""Helpers shared by the corpus operators: checkpoints, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words (space and 0x09-0x0D), as a regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The same six characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Null document ids sort behind every other id.
LAST_ID = 2**63 - 1
#: Rows in one Arrow batch sent to Python; texts are long, so few rows.
BATCH_ROWS = 500

_ODD = np.array(
    [int.from_bytes(xxhash.xxh64(b"place", seed=k).digest(), "big") | 1 for k in range(64)],
    dtype=np.uint64,
)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back.

    ``spark.checkpoint.dir`` names the folder on a cluster; only a local master
    (tests) gets a temporary folder of its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by rows and bytes, unless the session has its own setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster's owner sizes with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_last(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as no column of the input has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Parts into which joins deal the rows of one key.
SALTS = 8


def dealt_join(rows: DataFrame, values: DataFrame, key: str, spread: str) -> DataFrame:
    """The inner join of ``rows`` with ``values``, which has one row for each key, whatever share of the rows a key has.

    The rows of a key are dealt to ``SALTS`` tasks by ``spread``; the values go to each.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    everywhere = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(everywhere, [key, "_salt"]).drop("_salt")


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every text of an Arrow column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Words longer than this many bytes are hashed one by one.
_LONG_WORD = 256


def word_hashes(batch: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, eight bytes of all words at a time."""
    sizes = np.array([len(t) + 1 for t in batch], np.int64)
    joined = b" ".join(batch) + bytes([0x20]) * 9
    if lower:
        joined = joined.lower()
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    out = length.astype(np.uint64) * _ODD[1]
    own, at, left = np.arange(len(start)), start, length
    long_words = np.flatnonzero(length > _LONG_WORD)
    if len(long_words):
        short = np.flatnonzero(length <= _LONG_WORD)
        own, at, left = own[short], at[short], left[short]
    while len(own):
        part = eight[at] & _KEEP[np.minimum(left, 8)]
        h = (out[own] ^ part) * np.uint64(0x9FB21C651E98DF25)
        out[own] = h ^ (h >> np.uint64(35))
        more = np.flatnonzero(left > 8)
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in long_words.tolist():
        out[k] = xxhash.xxh3_64_intdigest(joined[start[k] : start[k] + length[k]])
    out = mixed(out)
    cuts = np.searchsorted(start, np.cumsum(sizes))
    return np.split(out, cuts[:-1])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits of sums are equally random."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes; the first of each run is its index."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    if n > len(_ODD):
        raise ValueError(f"runs of at most {len(_ODD)} words")
    m = len(words) - n + 1
    total = words[:m] * _ODD[0]
    for k in range(1, n):
        total += words[k : k + m] * _ODD[k]
    return mixed(total)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def dropped(table: DataFrame) -> None:
    """Deletes a ``stored`` table that nothing reads any more."""
    jvm = table.sparkSession.sparkContext._jvm
    for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the session's checkpoint folder; removed when the session ends."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def int64_lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists from one array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
