"""Driver tables (parquet) with the column subsets each job needs.

Selecting columns right at the scan lets Catalyst prune the parquet
``ReadSchema``; filters written later are pushed into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


class Tables:
    """Lazy accessors for the parquet tables under one directory."""

    def __init__(self, spark: SparkSession, root: str):
        from patronus.session import checkpoint_dir
        self.spark = spark
        self.root = root
        checkpoint_dir(spark)   # the cluster's shared folder; a private one only when unset

    def read(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))
        return df.select(*cols) if cols else df

    def orders(self) -> DataFrame:
        return self.read("orders", "o_orderkey", "o_custkey", "o_orderdate")

    def lineitem(self) -> DataFrame:
        return self.read("lineitem", "l_orderkey", "l_partkey", "l_quantity",
                         "l_extendedprice", "l_discount")

    def customer(self) -> DataFrame:
        return self.read("customer", "c_custkey", "c_nationkey")

    def nation(self) -> DataFrame:
        return self.read("nation", "n_nationkey", "n_name")

    def part(self) -> DataFrame:
        return self.read("part", "p_partkey", "p_name")

    def embeddings(self) -> DataFrame:
        return self.read("embeddings", "vec_id", "embedding", "label")


def tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)
