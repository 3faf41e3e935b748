"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated up to ``epochs``
times.  A document's virtual finish time is the words its source has queued up
to and including it, divided by the source's target.  All queues are then
merged in the order of that time and cut where the total budget is used up: a
source that may take twice as much gets twice the words by any point.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and
share ``share`` of all words; no target exceeds ``cap`` times its source's
words, what is over goes to the others by weight until none is above.

Running sums are made in two levels (cells of the shuffled order inside each
source, then a window inside each cell), so a source with a third of all rows is
many tasks.  The merge order is cut without sorting everything in one place:
words per slice of virtual time find the slice in which the budget ends, and
only that slice is ordered row by row, again and again narrowed by slices while
it is large.  The driver sees scalars only.

Defined results: a null or empty text has size 0, is never taken and moves no
queue; a null source is a source of its own, last in order; a source without
words has target 0; rows equal in key, source and size are taken together.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WS, WS_CLASS, md5_long, written

WEIGHTS = (3, 1, 2)


def word_count(c: Column) -> Column:
    t = F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_CLASS + "+"))).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, weight, source_size, target) per source.  Ranks come from one
    global sort (row ids rise with it; ids per partition are made gapless by the
    partitions' counts), the level of the caps from rounds of two sums."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("part", F.shiftright("id", 33)), "mix-sources")
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition of the sort
    before = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    table = F.expr(f"array({', '.join(map(str, weights))})")
    ranked = written(ordered.join(F.broadcast(before), "part").select(
        "source", "source_size", nth.alias("nth"),
        F.get(table, F.pmod(nth, F.lit(len(weights))).cast("int")).cast("long").alias("weight")), "mix-ranked")
    ratio = Fraction(share).limit_denominator(1000)
    first = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, weight, capped = int(first["s"] or 0), int(first["w"] or 0), 0
    exact = lambda c: c.cast("decimal(38,0)")
    while True:  # each round caps one source more at least, or is the last
        rest = ratio.numerator * total - ratio.denominator * capped
        full = exact(F.col("source_size")) * (cap * ratio.denominator * max(weight, 1)) <= exact(F.col("weight")) * rest
        row = ranked.select(full.alias("full"), "source_size", "weight").agg(
            F.sum(F.when(F.col("full"), F.col("source_size") * cap)).alias("capped"),
            F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
        if not row["weight"] or row["weight"] == weight:
            break
        capped, weight = int(row["capped"] or 0), int(row["weight"])
    budget = float(ratio * total)
    free = F.col("weight") * F.lit(budget - capped) / F.lit(float(max(weight, 1)))
    return ranked.withColumn("target", F.least(free, F.col("source_size").cast("double") * cap)), budget


def plan(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix",
         weights=WEIGHTS, share: float = 1.5, cap: int = 2, cells: int = 256, slices: int = 4096) -> DataFrame:
    """What the mix takes: (key, source, size, source_size, target, copies, finish)
    for each distinct (key, source, size).  Rows equal in these three queue as one,
    counted first, so repeated rows never meet in one task."""
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    items = rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    h = md5_long(F.concat_ws(":", F.lit(seed), F.col("key").cast("string")))
    items = written(items.withColumns({"h": h, "words": F.col("size") * F.col("rows")}), "mix-items")
    targets, budget = source_targets(items.select("source", F.col("words").alias("size")), weights, share, cap)
    items = items.withColumn("cell", F.floor(F.col("h") / F.lit((1 << 60) // cells)).cast("int"))
    sums = items.groupBy("source", "cell").agg(F.sum("words").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "cell", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("s2"), F.col("cell").alias("c2"), "before", "nth", "source_size", "target")
    inside = F.sum("words").over(Window.partitionBy("source", "cell").orderBy("h", "key", "size").rowsBetween(
        Window.unboundedPreceding, 0))
    queue = items.withColumn("inside", inside).join(
        offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")))
    queue = written(queue.select("key", "source", "size", "words", "nth", "source_size", "target",
                                 (F.col("before") + F.col("inside")).alias("queue")), "mix-queue")
    at = lambda e: F.col("queue") + e * F.col("source_size")
    time = lambda e: F.try_divide(at(e).cast("double"), F.col("target"))
    copies = F.explode(F.array(*[F.struct(at(e).alias("queue"), time(e).alias("finish")) for e in range(cap)]))
    merged = queue.where(F.col("words") > 0).select("nth", "words", copies.alias("c")).select("nth", "words", "c.*")
    cut = cut_point(merged, budget, slices)
    taken = sum((F.when((F.col("words") > 0) & _before_cut(time(e), F.col("nth"), at(e), cut), 1).otherwise(0)
                 for e in range(cap)), F.lit(0))
    return queue.select("key", "source", "size", "source_size", "target", taken.alias("copies"),
                        F.when(F.col("words") > 0, time(0)).alias("finish"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Every row of ``df`` with ``size``, ``source_size``, ``target``, ``copies`` (how
    often the mix takes the row, 0 to ``cap``) and ``finish`` (of the first copy)."""
    new = ("size", "source_size", "target", "copies", "finish")
    planned = plan(df, key, source, text, **options)
    rows = df.select(F.struct(*[c for c in df.columns if c not in new]).alias("in"), F.col(key).alias("k"),
                     F.col(source).cast("string").alias("s"), word_count(F.col(text)).alias("z"))
    both = rows.join(planned, F.col("k").eqNullSafe(F.col("key")) & F.col("s").eqNullSafe(F.col("source")) & (
        F.col("z") == F.col("size")))
    return both.select("in.*", *new)


def _before_cut(finish: Column, nth: Column, queue: Column, cut) -> Column:
    if cut is None:
        return F.lit(True)
    return (finish < F.lit(cut[0])) | ((finish == F.lit(cut[0])) & (
        (nth < F.lit(cut[1])) | ((nth == F.lit(cut[1])) & (queue < F.lit(cut[2])))))


def cut_point(items: DataFrame, budget: float, slices: int = 4096, at_once: int = 100_000):
    """(finish, nth, queue) of the first item, in that order, with which the words
    exceed the budget; None when all fit.  Virtual time is squeezed into (0, 1) and cut
    into ``slices`` equal ranges; the range with the cut is cut again until it holds at
    most ``at_once`` items, which are then ordered.  Items of one time are narrowed by
    their source's number and then by their place in its queue, which no two share."""
    used, columns = 0, ["u", "finish", "nth", "queue"]
    inside = items.withColumn("u", F.col("finish") / (F.col("finish") + 1))
    ends = {"u": (0.0, 1.0)}
    while open_ := [c for c in columns if ends.get(c, (0, 1))[0] < ends.get(c, (0, 1))[1]]:
        column, (lo, hi) = F.col(open_[0]), ends[open_[0]]
        width = float(hi - lo) / slices or 5e-324
        number = F.least(F.floor((column - F.lit(lo)).cast("double") / F.lit(width)), F.lit(slices - 1)).cast("int")
        per = inside.groupBy(number.alias("slice")).agg(
            F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"),
            *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))]).orderBy("slice")
        for r in per.collect():  # at most ``slices`` rows
            if used + r["words"] > budget:
                break
            used += r["words"]
        else:
            return None
        ends = {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in columns}
        inside = inside.where(column.between(*[F.lit(x) for x in ends[open_[0]]]))
        if r["n"] <= at_once:
            break
    running = F.sum("words").over(Window.orderBy("finish", "nth", "queue").rowsBetween(Window.unboundedPreceding, 0))
    first = inside.withColumn("running", running).where(F.col("running") + used > budget).orderBy("finish", "nth", "queue").first()
    return first["finish"], first["nth"], first["queue"]


def repeated(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns that came in."""
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
                       F.col(text).alias("text"))
    mixed = mix(packed, "key", "source", "text", **options).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
