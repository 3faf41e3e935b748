"""Ranks and running totals inside a few very large groups, spread over many tasks.

A window ``partitionBy(label)`` over two classes (or ``partitionBy(model)``
over a score column) runs as one task per group.  Here each group is cut
into ordered buckets (a prefix of the sort key, so bucket order agrees
with key order); per-bucket totals (small: groups × buckets rows) give each
bucket its offset, and the window runs per (group, bucket).  The result is
identical to the single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_level(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
              values: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums ``<name>`` of each value, ordered by
    ``order`` within ``group``.  ``bucket`` must be non-decreasing in ``order``."""
    x = df.withColumn("_b", bucket)
    for name, v in values.items():
        x = x.withColumn(f"_v_{name}", v)
    tot = x.groupBy(*group, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    w_off = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offs = tot.select(*group, "_b", *[(F.sum(f"_t_{n}").over(w_off) - F.col(f"_t_{n}")).alias(f"_o_{n}")
                                      for n in values])
    w_in = (Window.partitionBy(*group, "_b").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # offsets: groups × buckets rows — bounded by construction for every caller
    y = x.join(F.broadcast(offs), [*group, "_b"])
    for n in values:
        y = y.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(w_in))
    return y.drop("_b", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def rank_within(df: DataFrame, group: list[str], key: Column, tie: Column,
                prefix_chars: int = 3, name: str = "rank") -> DataFrame:
    """1-based row number ordered by (key, tie) within group, where ``key``
    is a hex string (an md5): its first ``prefix_chars`` characters bucket it."""
    return two_level(df, group, F.substring(key, 1, prefix_chars), [key, tie],
                     {name: F.lit(1).cast("long")})
