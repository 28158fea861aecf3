"""Exact filtered top-k retrieval by cosine, with probes, boosts and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import rules
from ..functions import text as T

#: Up to so many query vectors are broadcast together; more are taken in turns.
MOST_QUERIES = 1000
#: So many items are scored at once, which bounds a task's matrices.
SLICE_ROWS = 1024


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(items: DataFrame, query: list[float], k: int, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k items most like one vector; ties by key. Filters reach the scan, and each task keeps k rows only."""
    rows = items if where is None else items.where(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(cosine(F.col(vector), target), 6)).orderBy(F.col("score").desc(), key).limit(k)


def top_k_many(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query", cells: str | None = None) -> DataFrame:
    """The k items most like each query vector.

    Scores are matrix products of batches of items with all queries of a part. Each
    task keeps its own k best by query, so what moves grows with tasks times queries,
    not with items times queries. Queries go out in parts of at most MOST_QUERIES;
    items without a direction have no score and come last. ``cells`` names a column of the
    queries with the cells of the items (their column ``cell``) that a query may find.
    """
    parts, spark = -(-queries.count() // MOST_QUERIES) or 1, items.sparkSession
    schema = StructType([StructField("_n", IntegerType()), StructField("_k", items.schema[key].dataType), StructField("score", DoubleType())])
    out = None
    for p in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == p)
        # bounded: MOST_QUERIES vectors
        asked = own.select(query_key, query_vector, *([cells] if cells else [])).collect()
        width = len(asked[0][1]) if asked else 0
        probing: dict[int, list[int]] = {}
        for n, r in enumerate(asked):
            for cell in r[2] if cells else ():
                probing.setdefault(cell, []).append(n)
        shared = spark.sparkContext.broadcast((np.array([r[1] for r in asked], float).reshape(len(asked), width), k, probing if cells else None))
        plain = items.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), *(["cell"] if cells else []))
        local = plain.mapInArrow(_best_of_task(shared), schema)
        names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(asked)], StructType([StructField("_n", IntegerType()), own.schema[query_key]]))
        outer = Window.partitionBy("_n").orderBy(F.col("score").desc(), "_k")
        ranked = (local.where(F.col("score").isNotNull()) if cells else local).withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k).join(F.broadcast(names), "_n")
        ranked = ranked.select(query_key, F.col("_k").alias(key), "score", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _best_of_task(shared):
    """(_k, _v[, cell]) -> (_n, _k, score): a task's best items for each query.

    Items are scored ``SLICE_ROWS`` at a time; between slices a task holds k scores for each
    query and the keys of their items, however many items it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, k, probing = shared.value
        size = np.sqrt((asked * asked).sum(axis=1))
        keys: pa.ChunkedArray | None = None  # in order; ``place`` are places in it
        place, best = np.empty((0, len(asked)), np.int64), np.empty((0, len(asked)))
        for part in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            rows = [v if v is not None and len(v) == asked.shape[1] else None for v in part.column("_v").to_pylist()]
            items = np.array([np.full(asked.shape[1], np.nan) if v is None else v for v in rows], float).reshape(len(rows), asked.shape[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                length = np.sqrt((items * items).sum(axis=1))[:, None]
                if probing is None:
                    found = np.round(items @ asked.T / (length * size), 6)
                else:
                    # the items of a cell only with the queries that probe it
                    found, cell = np.full((len(items), len(asked)), np.nan), part.column("cell").to_numpy()
                    for c in np.unique(cell):
                        own, by = np.flatnonzero(cell == c), probing.get(int(c), [])
                        found[np.ix_(own, by)] = np.round(items[own] @ asked[by].T / (length[own] * size[by]), 6)
            # ties by key: all keys so far are put in order, and what no query ranks among its k best is not kept
            own_keys = pa.chunked_array([part.column("_k")])
            by_key = pc.sort_indices(own_keys).to_numpy()
            found = found[by_key]
            near = np.argsort(-np.nan_to_num(found, nan=-9.0), axis=0, kind="stable")[:k]
            before = 0 if keys is None else len(keys)
            keys = own_keys if keys is None else pa.chunked_array([*keys.chunks, *own_keys.chunks])
            order = pc.sort_indices(keys).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = np.concatenate([rank[place], rank[before + by_key[near]]])
            best = np.concatenate([best, np.take_along_axis(found, near, axis=0)])
            first = np.lexsort((place, -np.nan_to_num(best, nan=-9.0)), axis=0)[:k]
            place, best = np.take_along_axis(place, first, axis=0), np.take_along_axis(best, first, axis=0)
            used, place = np.unique(place, return_inverse=True)
            place = place.reshape(best.shape)
            keys = pa.chunked_array([keys.take(pa.array(order[used])).combine_chunks()])
        if keys is None or not len(asked):
            return
        number = np.tile(np.arange(len(asked), dtype=np.int32), len(best))
        value = best.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(number), keys.take(pa.array(place.ravel())).combine_chunks(), pa.array(value, mask=np.isnan(value))], names=["_n", "_k", "score"])

    return run


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in an order."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def multi_probe(items: DataFrame, query: list[float], probes: list[tuple[Column | None, int]], key: str = "vec_id", vector: str = "embedding", same: list[str] | None = None) -> DataFrame:
    """Searches under several filters; of equal hits the first probe's score stays."""
    found = None
    for number, (where, k) in enumerate(probes):
        part = top_k(items, query, k, where, key, vector).withColumn("probe", F.lit(number))
        found = part if found is None else found.unionByName(part)
    return first_of(found, same or [key], ["probe", F.col("score").desc(), key])


def probes_for(hints: list[str], single_source: bool, subject: bool = False, deadline: bool = False) -> list[tuple[str | None, int]]:
    """(section, k) of the searches for a question."""
    if single_source:
        return [*((h, 4) for h in hints[:2]), (None, 8)]
    if subject or deadline:
        return [*((h, 8) for h in hints[:2]), (None, 24 if subject else 20)]
    return [*((h, 10) for h in hints[:2]), (None, 25)]


def boosted(hits: DataFrame, k: int, bonus: Column) -> DataFrame:
    """Hits by score and bonus; ties by probe and score."""
    return hits.withColumn("boosted", F.round(F.col("score") + bonus, 6)).orderBy(F.col("boosted").desc(), "probe", F.col("score").desc(), "vec_id").limit(k)


def reranked(hits: DataFrame, k: int, focus: bool, by: list[str], ties: list[str]) -> DataFrame:
    """Hits with ``rerank``, ``bonus`` and ``score`` by rerank (with the bonus if focused), unless all reranks are tiny."""
    most = F.max("rerank").over(Window.partitionBy(*by))
    first = F.when(most < rules.RERANK_FLOOR, F.col("score")).otherwise(F.col("rerank") + (F.col("bonus") if focus else F.lit(0.0)))
    order = Window.partitionBy(*by).orderBy(F.col("_first").desc(), F.col("bonus").desc(), F.col("score").desc(), *ties)
    return hits.withColumn("_first", first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_first")


def single_source(hits: DataFrame, by: str) -> DataFrame:
    """The only source among a question's hits, or null."""
    return hits.groupBy(by).agg(F.when(F.count_distinct("source") == 1, F.min("source")).alias("source"))


def focus(rows: DataFrame, text: str, primary: list[str], support: list[str], penalty: list[str]) -> DataFrame:
    return rows.withColumn("bonus", F.round(T.focus_bonus(F.col(text), primary, support, penalty), 4))


def with_defaults(hits: DataFrame) -> DataFrame:
    """Hits with the defaults of what a reader misses."""
    fill = {"department": "shared", "page": "?", "source": "?", "section": "general"}
    return hits.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if c in hits.columns})
