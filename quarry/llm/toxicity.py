"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a text (lower-cased, white space as
one blank, none across a word's inside), hashed to ``2**BITS`` places. With p and
q the smoothed shares of toxic and other training texts that have a feature, its
value is r = log(p / q) scaled by whether the text has it; a logistic regression
with an L2 penalty is fitted on those values, and its weights times r are one
table of a fixed size that scores every text.

The model is fitted on at most ``MOST_TOXIC`` and ``MOST_OTHER`` labelled rows,
those whose hashed ids are least; all other work covers all rows and whole texts.

Defined cases: null or empty text has no features and the score of the bias; a
null id is held out or not by the CRC of the empty text; repeated rows get equal
scores; without labelled rows of both classes every score is the share of toxic
rows, or 0 without any labelled row; further columns are ignored.
Ids whose labels differ teach nothing; equal scores (ties) get equal predictions; a
very long text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ODD, mixed, rows_of, small_batches, stored

SIZES = (3, 4, 5)
BITS = 20
MOST_TOXIC, MOST_OTHER = 1500, 2500
PENALTY = 1.0
SMOOTH = 0.5
THRESHOLD = 0.7
#: Characters hashed together.
BLOCK_CHARS = 1_000_000
_FEATURES = 1 << BITS


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each text as one array, and where each text's begin (and the end)."""
    lowered = [t.lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in lowered])
    joined = ("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(joined, "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars[blank] = 32
    found = []
    for n in SIZES:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        inside = blank[1 : 1 + m].copy()
        for k in range(2, n - 1):
            inside |= blank[k : k + m]
        # of one text, without a blank in its inside
        good = np.flatnonzero(~inside & (doc[:m] == doc[n - 1 :]))
        h = chars[good] * _ODD[0]
        for k in range(1, n):
            h += chars[good + k] * _ODD[k]
        place = mixed(h + np.uint64(n)) >> np.uint64(64 - BITS)
        found.append((doc[good].astype(np.uint64) << np.uint64(BITS)) | place)
    both = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    edges = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (both & np.uint64(_FEATURES - 1)).astype(np.int32), edges


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of texts with about BLOCK_CHARS characters."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > BLOCK_CHARS:
            yield begin, k
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def minimised(loss, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving step; ``loss`` gives value and gradient."""
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, rho), a in zip(steps, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        slope, size = grad @ q, 1.0
        for _ in range(25):
            after, gradient = loss(w - size * q)
            if after <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, gradient - grad
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - after < 1e-6 * max(1.0, abs(value))
        w, value, grad = w + s, after, gradient
        if done:
            break
    return w


def fitted(places: np.ndarray, edges: np.ndarray, toxic: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weight of each feature, the ratio included, and the bias."""
    y = toxic.astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(_FEATURES, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    used, place = np.unique(places, return_inverse=True)
    place = place.astype(np.int32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(edges))
    has = np.bincount(place, weights=y[row], minlength=len(used))
    lacks = np.bincount(place, minlength=len(used)) - has
    r = np.log((has + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log((lacks + SMOOTH) / ((1 - y).sum() + 2 * SMOOTH))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled = w[:-1] * r
        z = np.bincount(row, weights=scaled[place], minlength=len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        value = -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + penalty / 2 * (w[:-1] ** 2).sum()
        g = weight * (p - y)
        gradient = np.append(np.bincount(place, weights=g[row], minlength=len(used)) * r + penalty * w[:-1], g.sum())
        return value, gradient

    w = minimised(loss, np.zeros(len(used) + 1))
    table = np.zeros(_FEATURES, np.float32)
    table[used] = (w[:-1] * r).astype(np.float32)
    return table, float(w[-1])


def scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b in blocks(texts):
        places, edges = features(texts[a:b])
        total = np.concatenate([[0.0], np.cumsum(table[places], dtype=np.float64)])
        out[a:b] = total[edges[1:]] - total[edges[:-1]] + bias
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        own, made = _texts(batch), []
        for a, b in blocks(own):
            places, edges = features(own[a:b])
            made += [places[x:y].tobytes() for x, y in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(made, pa.binary())], names=["label", "features"])


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id's decimal text, modulo."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], allowed: Column) -> DataFrame:
    """(label, text) of at most ``most[c]`` allowed rows of each class c, by the least hashed ids.

    Ids with different labels are left out. Rows that repeat an id and a text are one; an id
    that comes with many texts counts with each, so the bound holds for rows, not only for ids.
    """
    own = labels.where(F.col("doc_id").isNotNull() & allowed).select("doc_id", F.col(label).cast("int").alias("label"))
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    parts = [own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # bounded: as many ids as the sample has rows
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, label int")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    # one row for each id and text, then as many as are asked for; only these are collected
    rows = texts.groupBy("doc_id", "label", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("print")).agg(F.first("text").alias("text"))
    rows = stored(rows)  # read once for each class
    least = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "print").limit(n) for c, n in most.items()]
    sample = least[0]
    for part in least[1:]:
        sample = sample.unionByName(part)
    return sample.select("label", "text")


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[np.ndarray, float]:
    """Fits the model on the bounded sample of allowed labelled rows."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", {1: MOST_TOXIC, 0: MOST_OTHER}, allowed)
    made = sample.mapInArrow(_features, "label int, features binary").toArrow()
    # in one order, whatever the tasks' was, so that the same sums come out
    rows = sorted(zip(made.column("features").to_pylist(), made.column("label").to_pylist()))
    parts = [np.frombuffer(x, "<i4") for x, _ in rows]
    edges = np.cumsum([0] + [len(p) for p in parts])
    return fitted(np.concatenate([np.empty(0, np.int32), *parts]), edges, np.array([label for _, label in rows], np.int32))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(scores(_texts(batch), table, bias))], names=[*batch.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score) for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return toxicity(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
