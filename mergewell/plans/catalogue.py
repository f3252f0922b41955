"""All queries of the engine and their SQL twins.

Query modules register themselves here with the decorator; the name is the function's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from mergewell.plans import catalog_queries, command_queries, key_queries, ingest_queries, lookup_queries, scalar_queries, search_queries, update_queries, library_queries, user_queries  # noqa: E402, F401
