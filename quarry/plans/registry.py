"""Registry of the engine's named queries and of their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "topk_cosine"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query, and its SQL where there is one, under ``name``."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add
