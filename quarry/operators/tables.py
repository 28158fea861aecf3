"""Key-based inserts, updates and deletes on tables without a transaction log, and paging.

Every function returns the table's new contents; a caller writes them beside the
old ones and swaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def insert_if_absent(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows replace those of equal key."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Values of ``changes`` that are not null replace those of the rows with the key."""
    names = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_universe(universe: str, universes: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Universes, documents and chunks without a universe and what belongs to it, by document and by source."""
    own = documents.where(F.col("universe_id") == universe)
    left = delete(delete(chunks, own.select(F.col("id").alias("doc_id")), "doc_id"), own.select(F.col("filename").alias("source")), "source")
    return universes.where(F.col("id") != universe), documents.where(~F.col("universe_id").eqNullSafe(F.lit(universe))), left


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page of ordered rows; ``order`` must be total."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def newest(rows: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(at).desc(), *ties).limit(n)


def stamp_departments(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's department."""
    owners = documents.select(F.col("id").alias("doc_id"), F.col("department_id").alias("_department"))
    return chunks.join(owners, "doc_id", "left").withColumn("department", F.coalesce("_department", "department")).drop("_department").select(chunks.columns)


def unique_names(uploads: DataFrame) -> DataFrame:
    """Stored names without collision: base, then hash8_base, then hash8_2_base and so on."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("filename").orderBy("file_hash", "id"))
    again = F.row_number().over(Window.partitionBy("filename", F.substring("file_hash", 1, 8)).orderBy("file_hash", "id"))
    named = uploads.withColumns({"_n": order, "_m": again})
    start = F.concat(F.substring("file_hash", 1, 8), F.lit("_"))
    first = F.min(F.when(F.col("_n") == 1, F.substring("file_hash", 1, 8))).over(Window.partitionBy("filename"))
    named = named.withColumn("_k", F.col("_m") - F.when(first == F.substring("file_hash", 1, 8), 1).otherwise(0))
    stored = (
        F.when(F.col("_n") == 1, F.col("filename"))
        .when(F.col("_k") <= 1, F.concat(start, "filename"))
        .otherwise(F.concat(start, F.col("_k").cast("string"), F.lit("_"), "filename"))
    )
    return named.withColumn("stored_name", stored).drop("_n", "_m", "_k")
