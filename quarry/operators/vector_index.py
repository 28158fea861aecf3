"""Inverted-file index of vectors: centroids, rows by cell, searches that read only probed cells.

The centroids are fitted on a bounded sample of the rows, those with the least hashed keys;
every row gets the cell of its nearest centroid and is written under it, so a search prunes
the folders of all other cells. How near the result is to the exact one depends on the
number of probed cells; ``retrieval.top_k_many`` is the exact way.

A cell may hold any share of the rows: it is written by many tasks and read by many. Rows
without a direction (null, zero or of another width) have the cell -1, which no search reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import SLICE_ROWS, top_k_many

#: Rows on which the centroids are fitted, rounds of fitting, and the most cells.
FIT_ROWS, ROUNDS, MOST_CELLS = 20_000, 15, 1024
#: Files of a cell are written by so many tasks at least for one in so many rows.
FILE_ROWS = 1_000_000


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Unit vectors; nan where a vector has no direction."""
    out = np.full((len(vectors), width), np.nan)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == width and None not in v:
            out[k] = v
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _sampled(items: DataFrame, key: str, vector: str, fit_rows: int) -> list:
    """Vectors of the rows with the least hashed keys; bounded."""
    return [r[0] for r in items.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).select(vector).limit(fit_rows).collect()]


def fit(items: DataFrame, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centroids by spherical k-means; by default as many as the square root of the number of rows."""
    sample = _sampled(items, key, vector, fit_rows)
    width = max(map(len, sample), default=0)
    rows = _matrix(sample, width)
    rows = np.unique(rows[~np.isnan(rows).any(axis=1)], axis=0)
    n = min(cells or min(MOST_CELLS, int(np.sqrt(items.count())) or 1), len(rows))
    if not n:
        return np.empty((0, width))
    rng = np.random.default_rng(1)
    # each next centroid far from those chosen before
    chosen = [int(rng.integers(len(rows)))]
    near = rows @ rows[chosen[0]]
    while len(chosen) < n:
        far = np.maximum(1 - near, 0) + 1e-12
        chosen.append(int(rng.choice(len(rows), p=far / far.sum())))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def probes_for(items: DataFrame, centroids: np.ndarray, target: float = 0.95, k: int = 10, key: str = "vec_id", vector: str = "embedding", fit_rows: int = FIT_ROWS) -> int:
    """The least number of probes with which the sample's own k nearest are found to this share.

    Neighbours in the sample are farther apart than in the whole table, so the share in the
    table is rather higher.
    """
    if len(centroids) < 2:
        return 1
    rows = _matrix(_sampled(items, key, vector, fit_rows), centroids.shape[1])
    rows = rows[~np.isnan(rows).any(axis=1)]
    asked = rows[:500]
    near = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    # at which probe of each query the cell of each neighbour comes
    place = np.argsort(order, axis=1)
    at = np.take_along_axis(place, np.argmax(rows @ centroids.T, axis=1)[near], axis=1)
    return int(np.quantile(at, target, method="higher")) + 1


def assigned(items: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``items`` with the ``cell`` of every row."""
    shared = items.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            cell = np.full(batch.num_rows, -1, np.int32)
            if len(own):
                rows = _matrix(batch.column(vector).to_pylist(), own.shape[1])
                some = ~np.isnan(rows).any(axis=1)
                cell[some] = np.argmax(rows[some] @ own.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return items.mapInArrow(run, f"{', '.join(f'`{n}` {kind}' for n, kind in items.dtypes)}, cell int")


def write(items: DataFrame, folder: str, centroids: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> None:
    """The index as Parquet: ``rows`` by cell, and ``centroids``."""
    spark = items.sparkSession
    spread = F.pmod(F.xxhash64(key), F.lit(-(-items.count() // FILE_ROWS) or 1))
    assigned(items, centroids, vector).repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    rows = [(k, c.tolist()) for k, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """(rows with their cell, centroids) of a written index."""
    own = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
    return spark.read.parquet(f"{folder}/rows"), np.array([r["centroid"] for r in own])


def probed(queries: DataFrame, centroids: np.ndarray, probes: int, vector: str = "query") -> DataFrame:
    """``queries`` with the ``cells`` of the nearest centroids."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = np.nan_to_num(_matrix(batch.column(vector).to_pylist(), own.shape[1] if len(own) else 0))
            cells = np.argsort(-(rows @ own.T), axis=1, kind="stable")[:, :probes] if len(own) else np.empty((len(rows), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return queries.mapInArrow(run, f"{', '.join(f'`{n}` {kind}' for n, kind in queries.dtypes)}, cells array<int>")


def search(rows: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most like each query (query_id, query) among those of its ``probes`` nearest cells.

    The cells of all queries of a part are read; a query gets scores only from its own.
    """
    asked = probed(queries, centroids, probes)
    # at most MOST_CELLS numbers
    wanted = [r[0] for r in asked.select(F.explode("cells")).distinct().collect()]
    return top_k_many(rows.where(F.col("cell").isin(wanted)), asked, k, key, vector, cells="cells")


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, n, hits): how many of a query's exact results were found."""
    hit = exact.join(found.select("query_id", key).withColumn("_hit", F.lit(1)), ["query_id", key], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
