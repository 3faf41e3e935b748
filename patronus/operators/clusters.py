"""Customer clusters (B11) and their labels.

k-means (Lloyd) on standardised Recency, Frequency, Monetary with a
deterministic start, so the same customers get the same cluster on every
run and partitioning:

* start centre i sits at the exact quantile p_i = (i + 0.5) / k of F and M
  and at 1 - p_i of R (centre 0 is the recent / frequent / high-spend one);
* each iteration assigns every point to the nearest centre (ties to the
  lower index) and moves each centre to the mean of its points (an empty
  cluster keeps its centre);
* it stops when no centre moves by more than 1e-9.  Lloyd's iteration reaches
  that in finitely many steps; ``safety`` iterations without it are an error,
  never an answer.

Each iteration is one distributed pass (assign + partial aggregate of
k × 3 sums); only the k × 3 centre coordinates reach the driver, as in
MLlib's KMeans.  The points are persisted for the iterations.

Labels: clusters ranked by mean Monetary → VIP, High Value; of the other
two, the one with the lower mean Recency is Active Mid, the other Dormant
Low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronus import config as C
from patronus.operators.blocks import kept, sums
from patronus.operators.quantiles import exact_quantiles

FEATURES = ["Recency", "Frequency", "Monetary"]
K = 4
SAFETY = 10_000
TOL = 1e-9


def start_probs(k: int = K) -> list[float]:
    return [(i + 0.5) / k for i in range(k)]


def _z(c: str, mean: float, std: float) -> Column:
    if not std:
        return F.lit(0.0)
    return (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)


def assign_expr(centers: list[list[float]]) -> Column:
    """Index of the nearest centre, ties to the lower index."""
    d = [sum(((F.col(f"z{j}") - F.lit(float(c[j]))) ** 2 for j in range(3)), F.lit(0.0))
         for c in centers]
    expr = None
    for i in range(len(d) - 1):
        cond = None
        for j in range(i + 1, len(d)):
            c = d[i] <= d[j]
            cond = c if cond is None else cond & c
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr.otherwise(len(d) - 1) if expr is not None else F.lit(0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points as blocks of n × 3 numbers, nulls as NaN."""
    for batch in batches:
        z = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([len(z)], pa.int32()), pa.array([z.tobytes()], pa.binary())], names=["n", "z"])


def _step(centers: list[list[float]]):
    """Adds up, per nearest centre (as ``assign_expr``: ties to the lower index, points with
    a null to the last), the three coordinates and how many of each there are."""
    def add_to(b: dict, held: dict) -> None:
        z = b["z"].reshape(-1, 3)
        d = np.stack([(z[:, 0] - c[0]) ** 2 + (z[:, 1] - c[1]) ** 2 + (z[:, 2] - c[2]) ** 2 for c in centers])
        nearest = np.where(np.isnan(d[0]), len(centers) - 1, d.argmin(0))
        for i in np.unique(nearest):
            mine = z[nearest == i]
            held[int(i)] = held.get(int(i), np.zeros(6)) + np.concatenate([np.nansum(mine, 0), (~np.isnan(mine)).sum(0)])
    return add_to


def fit(base: DataFrame, k: int = K, safety: int = SAFETY):
    """Return (centers, means, stds) — small driver-side fitted statistics."""
    s = base.agg(*[F.avg(c).alias(f"mean_{c}") for c in FEATURES],
                 *[F.stddev_pop(c).alias(f"std_{c}") for c in FEATURES]).first()
    means = [float(s[f"mean_{c}"]) for c in FEATURES]
    stds = [float(s[f"std_{c}"] or 0.0) for c in FEATURES]
    probs = start_probs(k)
    qs = exact_quantiles(base, FEATURES, sorted(set(probs + [1 - p for p in probs]))).collect()
    q = {(r["metric"], round(r["p"], 12)): r["q"] for r in qs}

    def zval(j, v):
        return (v - means[j]) / stds[j] if stds[j] else 0.0

    centers = [[zval(0, q[("Recency", round(1 - p, 12))]),
                zval(1, q[("Frequency", round(p, 12))]),
                zval(2, q[("Monetary", round(p, 12))])] for p in probs]

    pts = base.select(*[_z(c, means[j], stds[j]).alias(f"z{j}") for j, c in enumerate(FEATURES)])
    pts = kept(pts.mapInArrow(_pack, "n int, z binary"))
    try:
        for _ in range(safety):
            new = [list(c) for c in centers]
            for i, v in sums(pts, _step(centers)).items():
                new[i] = [float(v[j] / v[3 + j]) if v[3 + j] else new[i][j] for j in range(3)]
            # converged: no centre moves (beyond float noise of the sums)
            if max(abs(a - b) for c0, c1 in zip(new, centers) for a, b in zip(c0, c1)) <= TOL:
                centers = new
                break
            centers = new
        else:
            raise RuntimeError(f"k-means did not converge in {safety} iterations")
    finally:
        pts.unpersist()
    return centers, means, stds


def label_clusters(assigned: DataFrame) -> DataFrame:
    """(Cluster, ClusterLabel) from per-cluster means (≤ k rows)."""
    st = assigned.groupBy("Cluster").agg(F.avg("Monetary").alias("am"), F.avg("Recency").alias("ar"))
    by_money = st.withColumn("mrank", F.row_number().over(
        Window.orderBy(F.col("am").desc(), F.col("Cluster"))))
    rest = F.row_number().over(Window.partitionBy(F.col("mrank") <= 2).orderBy(F.col("ar"), F.col("Cluster")))
    return by_money.select(
        "Cluster",
        F.when(F.col("mrank") == 1, C.CLUSTER_LABELS[0])
         .when(F.col("mrank") == 2, C.CLUSTER_LABELS[1])
         .when(rest == 1, C.CLUSTER_LABELS[2])
         .otherwise(C.CLUSTER_LABELS[3]).alias("ClusterLabel"))


def with_clusters(base: DataFrame, k: int = K) -> DataFrame:
    """Add Cluster (int) and ClusterLabel to a frame holding R, F, M."""
    # The customer table is read by the fit (statistics, quantiles, passes)
    # and by the assignment: write it once to the shared checkpoint folder,
    # which also cuts its lineage back to lineitem.
    base = base.checkpoint(eager=True)
    centers, means, stds = fit(base, k)
    z = [_z(c, means[j], stds[j]).alias(f"z{j}") for j, c in enumerate(FEATURES)]
    assigned = (base.select("*", *z).withColumn("Cluster", assign_expr(centers).cast("int"))
                    .drop("z0", "z1", "z2"))
    # ≤ k label rows: a proven size bound for the broadcast
    return assigned.join(F.broadcast(label_clusters(assigned)), "Cluster").select(
        *base.columns, "Cluster", "ClusterLabel")
