"""The inverted-file index: recall against the exact search, pruned reads, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import retrieval, vector_index
from quarry.plans import registry
from quarry.session import table


def test_recall_and_pruning(spark, sf_dir, tmp_path):
    items = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "embeddings")
    queries = items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centroids = vector_index.fit(items)
    assert len(centroids) == int(np.sqrt(items.count()))
    vector_index.write(items, str(tmp_path), centroids)
    rows, read = vector_index.read(spark, str(tmp_path))
    assert np.allclose(read, centroids) and rows.count() == items.count()
    exact = retrieval.top_k_many(items, queries, 10)
    probes = vector_index.probes_for(items, read)
    assert 1 <= probes < len(read)
    found = vector_index.search(rows, read, queries, 10, probes)
    share = vector_index.recall(found, exact).agg(F.sum("hits") / F.sum("n")).collect()[0][0]
    print("recall", share, "probes", probes, "of", len(read))
    assert share >= 0.9
    one = vector_index.search(rows, read, queries.where("query_id = 0"), 10, probes=2)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() or "PartitionFilters: [cell" in one._jdf.queryExecution().toString()
    assert {p.split("cell=")[1].split("/")[0] for p in rows.where(F.col("cell").isin(0, 1)).inputFiles()} and one.count() <= 10
    # all cells probed: the exact result
    whole = vector_index.search(rows, read, queries, 10, probes=len(read))
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    assert key(whole) == key(exact)


def test_awkward_vectors(spark):
    rows = [(k, [float(k % 3), 1.0, 0.5]) for k in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0]), (43, []), (None, [1.0, 1.0, 1.0])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    centroids = vector_index.fit(items, 5)
    assert len(centroids) == 4  # distinct directions
    cells = {r["vec_id"]: r["cell"] for r in vector_index.assigned(items, centroids).collect()}
    assert [cells[k] for k in (40, 41, 42, 43)] == [-1] * 4 and min(cells[k] for k in range(40)) >= 0
    queries = spark.createDataFrame([(1, [1.0, 1.0, 0.5])], "query_id int, query array<double>")
    found = vector_index.search(vector_index.assigned(items, centroids), centroids, queries, 5, probes=1)
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == [1, 4, 7, 10, 13]
    nothing = items.limit(0)
    assert vector_index.search(vector_index.assigned(nothing, vector_index.fit(nothing)), vector_index.fit(nothing), queries, 5).count() == 0


def test_registered_query(spark, sf_dir):
    found = registry.QUERIES["indexed_topk"](spark, sf_dir)
    assert found.columns == ["query_id", "vec_id", "score", "rank"] and found.count() > 0
