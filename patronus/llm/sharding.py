"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and the virtual nodes of every shard have a place on a ring (60 bits of
md5).  A key belongs to the first virtual node at or after its place; where that
node's shard is full it goes on clockwise to the next node of a shard with room.
With ``slack = 0`` the bounds are the counts that differ by one at most, so the
shards hold equal numbers of rows; with more slack fewer keys move on.

Only counts are needed to decide: all keys between two virtual nodes (an arc)
take the same way, so the filling of the ring is worked out from the
shards x virtual-nodes arc counts (bounded by the two parameters), and yields a
few rank ranges per arc.  Rows find their range by their rank inside the arc,
computed in two levels: counts of (arc, cell) and a row number inside each cell.
Cells that repeated rows make heavy are split further by row, so no task holds
more than about ``cell_rows`` rows of a key.

Defined results: a null key has its own place on the ring; rows that share a key
may be parted where a bound falls inside their arc; an empty table gives an
empty result; a null text counts as empty (size 1).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import md5_long, text_or_empty, written


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order."""
    return sorted((int(hashlib.md5(f"shard:{s}:{v}".encode()).hexdigest()[:15], 16), s)
                  for s in range(shards) for v in range(virtual_nodes))


def fill(nodes: list[tuple[int, int]], counts: dict[int, int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): every arc's ranks dealt to
    shards.  Hop by hop: each node offers what waits at it, in ring order, to its
    shard; what does not fit waits at the next node.  The work is bounded by the
    number of nodes, not by the number of keys."""
    free, used, out = list(bounds), [0] * len(bounds), []
    waiting = [[(arc, 0, counts.get(arc, 0))] if counts.get(arc) else [] for arc in range(len(nodes))]
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for at, (_, shard) in enumerate(nodes):
            for arc, lo, hi in waiting[at]:
                take = min(hi - lo, free[shard])
                if take:
                    out.append((arc, lo, lo + take, shard, used[shard]))
                    used[shard] += take
                    free[shard] -= take
                if lo + take < hi:
                    moved[(at + 1) % len(nodes)].append((arc, lo + take, hi))
        waiting = moved
    return out


def bounds_for(rows: int, shards: int, slack: float) -> list[int]:
    """Bounded loads: the even counts, or (1 + slack) times the mean."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * (1 + slack) * 1000) // (1000 * shards)) + 1] * shards


def assign(df: DataFrame, key: str = "doc_id", shards: int = 16, virtual_nodes: int = 64, slack: float = 0.0,
           cells: int = 64, cell_rows: int = 50_000) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Rows are shuffled once, by (arc, cell, split).  The tables of heavy cells and of
    rank ranges have at most shards x virtual_nodes x cells rows and are broadcast
    within that bound; the counts before each split grow with the rows and are joined
    by the key that the rows are already dealt by.
    """
    spark: SparkSession = df.sparkSession
    nodes = ring(shards, virtual_nodes)
    order = F.xxhash64(F.col(key).cast("string"), F.lit("order"))
    rows = df.select(F.struct(*df.columns).alias("in"), md5_long(F.col(key)).alias("place"), order.alias("ord"))
    rows = rows.withColumns({"arc": arc_of(F.col("place"), [p for p, _ in nodes]),
                             "cell": F.pmod("ord", F.lit(cells)).cast("int"), "id": F.monotonically_increasing_id()})
    rows = written(rows, "shard-keys")  # also fixes the row ids
    counts = rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.where(F.col("n") > cell_rows).select("arc", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("splits"))
    rows = rows.join(F.broadcast(heavy), ["arc", "cell"], "left").withColumn("part", F.when(
        F.col("splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("splits")).cast("int"))).drop("splits")
    sizes = rows.groupBy("arc", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("arc", "cell", "part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    per_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    dealt = fill(nodes, per_arc, bounds_for(sum(per_arc.values()), shards, slack))
    ranges = spark.createDataFrame(dealt, "arc int, lo long, hi long, shard int, slot0 long")
    nth = F.row_number().over(Window.partitionBy("arc", "cell", "part").orderBy("ord", "place", "id")) - 1
    ranked = rows.withColumn("nth", nth).join(before, ["arc", "cell", "part"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before"))
    found = ranked.join(F.broadcast(ranges.withColumnRenamed("arc", "arc2")), (F.col("arc") == F.col("arc2")) & (
        F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select(*[F.col("in")[c].alias(c) for c in df.columns if c not in ("shard", "slot")],
                        "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def arc_of(place: Column, places: list[int]) -> Column:
    """The index of the first node at or after a place, past the last one 0.  The
    ring is cut into equal pieces; a constant array has the first node of each,
    and as many steps as the fullest piece has nodes find the one."""
    pieces = 4 * len(places)
    width = -(-(1 << 60) // pieces)
    starts = [bisect_left(places, i * width) for i in range(pieces + 1)]
    constant = lambda xs, kind: F.expr(f"array({', '.join(map(str, xs))})").cast(f"array<{kind}>")
    first, spots = constant(starts, "int"), constant(places, "bigint")
    start = F.get(first, F.expr("0") + F.floor(place / F.lit(width)).cast("int"))
    for _ in range(max(b - a for a, b in zip(starts, starts[1:], strict=False))):
        start = start + F.when(F.get(spots, start) < place, 1).otherwise(0)
    return F.pmod(start, F.lit(len(places))).cast("int")


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size`` (UTF-8 bytes + 1) and ``text_crc32``."""
    t = text_or_empty(text)
    return df.withColumns({"size": (F.octet_length(t) + 1).cast("long"), "text_crc32": F.crc32(t.cast("binary")).cast("long")})
