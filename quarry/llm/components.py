"""Connected components of an edge table by alternating large and small stars.

The edges of one node, a hub that a third of all may be linked with, are dealt to
several tasks; what they are joined with is one row for each node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, dropped, stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) pairs -> u with the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = dealt_join(both.where("v > u"), _least(both), "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = dealt_join(down, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Table (u, v) of long ids -> table (node, label), the label being the component's least id.

    Only nodes with an edge to another node are returned. Every round writes its
    edges to the shared folder, so a lost executor costs one round at most.
    """
    edges = stored(edges.where("u <> v").select("u", "v").distinct())
    print_of = lambda t: t.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).collect()[0]
    before = print_of(edges)
    for _ in range(most_rounds if before[0] else 0):
        last, edges = edges, stored(_small_star(_large_star(edges)))
        dropped(last)
        now = print_of(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select("label", "label").toDF("node", "label")).distinct()
