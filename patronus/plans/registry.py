"""Named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every registered query reads the driver tables (or frames Spark derives
from them), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    """Register the DuckDB statement that states ``name``'s result."""
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = sql
