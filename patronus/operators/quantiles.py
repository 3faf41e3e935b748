"""Exact quantiles (linear interpolation) computed without a single-task merge.

Spark's exact ``percentile`` keeps a value→count map per group and merges
all of it in one task for a global quantile: fine for small domains (days,
order counts), unbounded for money columns.  Here the work is spread out:

1. long form (metric, v) → ``groupBy(metric, v).count()``: a hot value
   collapses to one row in the map-side partial aggregate;
2. one small job returns, per metric, n and the number of distinct values
   d; the bucket count is chosen so a bucket holds about ``per_bucket``
   distinct values; only when more than one bucket is needed, a second
   small job returns ``buckets - 1`` approximate quantile boundaries (a
   bounded sketch, ≤ ``max_buckets`` doubles per metric);
3. each distinct value finds its bucket by binary search (a balanced CASE
   tree, O(log B) per value);
4. bucket totals (≤ metrics × buckets rows) → prefix offsets;
5. per-bucket running counts (window partitioned by (metric, bucket), so the
   work spreads over many tasks) give each distinct value its rank range;
6. one global aggregate picks the values at ranks floor(p·(n-1)) and the
   next one and interpolates ``lo + (hi - lo) * frac`` (the SQL
   ``quantile_cont`` formula).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(v: Column, splits: list[float], lo: int = 0) -> Column:
    """Bucket index of v for sorted distinct splits (v < splits[0] → lo)."""
    if not splits:
        return F.lit(lo)
    mid = len(splits) // 2
    return F.when(v < F.lit(splits[mid]), search(v, splits[:mid], lo)) \
            .otherwise(search(v, splits[mid + 1:], lo + mid + 1))


def quantile_row(df: DataFrame, spec: dict[str, str], probs: list[float],
                 names: dict[str, list[str]] | None = None,
                 per_bucket: int = 2_000_000, max_buckets: int = 1024,
                 accuracy: int = 10000) -> DataFrame:
    """One-row frame with a column per (col, p), named ``names[col][i]``
    (default ``{col}_p{i}``).  ``spec`` maps column name → metric tag."""
    cols = list(spec)
    names = names or {c: [f"{c}_p{i}" for i in range(len(probs))] for c in cols}
    long = (df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v"))
                for c in cols])).alias("kv"))
              .select("kv.metric", "kv.v")
              .where(F.col("v").isNotNull()))
    # read by up to three jobs (summary, sketch, ranks): computed once and
    # written to the shared checkpoint folder
    vc = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c")).checkpoint(eager=True)

    # ≤ len(cols) small rows: n and the number of distinct values d
    summary = {r["metric"]: r.asDict() for r in
               vc.groupBy("metric").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    nbs = {m: min(max_buckets, max(1, math.ceil(r["d"] / per_bucket))) for m, r in summary.items()}
    if any(nb > 1 for nb in nbs.values()):
        fracs = [i / max_buckets for i in range(1, max_buckets)]
        # ≤ len(cols) rows of ≤ max_buckets doubles: a bounded driver result
        for r in vc.groupBy("metric").agg(F.percentile_approx("v", fracs, accuracy).alias("bounds")).collect():
            summary[r["metric"]]["bounds"] = r["bounds"]

    bucket = None
    for m, r in summary.items():
        nb = nbs[m]
        if nb == 1:
            continue
        splits = sorted({float(r["bounds"][round(i * max_buckets / nb) - 1]) for i in range(1, nb)})
        e = search(F.col("v"), splits)
        bucket = F.when(F.col("metric") == m, e) if bucket is None else bucket.when(F.col("metric") == m, e)
    vb = vc.withColumn("b", bucket.otherwise(0) if bucket is not None else F.lit(0))

    per_b = vb.groupBy("metric", "b").agg(F.sum("c").alias("bc"))
    w_off = (Window.partitionBy("metric").orderBy("b")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # ≤ metrics × buckets rows: a proven bound for the broadcast
    offsets = per_b.withColumn("off", F.sum("bc").over(w_off) - F.col("bc")).drop("bc")
    w_in = (Window.partitionBy("metric", "b").orderBy("v")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (vb.join(F.broadcast(offsets), ["metric", "b"])
                .withColumn("end", F.col("off") + F.sum("c").over(w_in))
                .withColumn("start", F.col("end") - F.col("c")))

    aggs, finals = [], []
    for c in cols:
        r = summary.get(c)
        for p, nm in zip(probs, names[c]):
            if r is None:
                finals.append(F.lit(None).cast("double").alias(nm))
                continue
            n = int(r["n"])
            pos = p * (n - 1)
            k = math.floor(pos)
            k2 = min(k + 1, n - 1)
            frac = pos - k
            is_m = F.col("metric") == c
            lo = F.max(F.when(is_m & (F.col("start") <= k) & (F.col("end") > k), F.col("v")))
            hi = F.max(F.when(is_m & (F.col("start") <= k2) & (F.col("end") > k2), F.col("v")))
            aggs += [lo.alias(f"{nm}__lo"), hi.alias(f"{nm}__hi")]
            lo_c, hi_c = F.col(f"{nm}__lo"), F.col(f"{nm}__hi")
            finals.append((lo_c if frac == 0 else lo_c + (hi_c - lo_c) * F.lit(frac)).alias(nm))
    return ranked.agg(*aggs).select(*finals) if aggs else df.sparkSession.range(1).select(*finals)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], **kw) -> DataFrame:
    """Long form: (metric string, p double, q double) for every col × prob."""
    names = {c: [f"q{i}_{j}" for j in range(len(probs))] for i, c in enumerate(cols)}
    row = quantile_row(df, {c: c for c in cols}, probs, names, **kw)
    items = [F.struct(F.lit(c).alias("metric"), F.lit(float(p)).alias("p"),
                      F.col(names[c][j]).alias("q"))
             for c in cols for j, p in enumerate(probs)]
    return row.select(F.explode(F.array(*items)).alias("t")).select("t.*")
