"""Named queries over the driver's tables and the SQL that checks them.

Documents stand for source files, pages for paths, orders for classes with their lineitems as methods, and a graph of
parts (successive parts of an order) for the import graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function, with its oracle where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


from . import code_queries, graph_queries, project_queries, source_queries, text_queries, upkeep_queries  # noqa: E402, F401
