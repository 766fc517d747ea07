"""Every query of the library by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Put a function in the catalogue under its name, with SQL for its rows."""

    def put(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is there already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


from tarnwell.plans import cluster_queries, codec_queries, history_queries, measure_queries, routing_queries, state_queries, storage_queries  # noqa: E402, F401
