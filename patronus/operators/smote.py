"""SMOTE over-sampling of the minority class (M8), keyed and partition-free.

* minority rows get a 1-based rank in md5 order (two-level ranking);
* their k nearest minority neighbours come from the blocked k-NN kernel;
* synthetic row s (s = 0 .. n_major − n_minor − 1) draws, from keyed
  uniforms on s, a base rank, one of its k neighbours and a gap u ∈ [0, 1):
  x = x_base + u · (x_neighbour − x_base);
* every draw is an equi-join (rank, neighbour id), so no row is chosen by
  a driver loop and the result is the same on every run.

Only fit rows are over-sampled; evaluation rows are never touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronus import config as C
from patronus.functions.keyed import keyed_hex, keyed_uniform
from patronus.operators.knn import knn
from patronus.operators.prefix import rank_within


class SmoteError(ValueError):
    pass


def needs_smote(fit_rows: DataFrame, label: str = "label") -> bool:
    rate = fit_rows.agg(F.avg(label)).first()[0]
    return rate is not None and (rate < C.SMOTE_LOW or rate > C.SMOTE_HIGH)


def smote(fit_rows: DataFrame, key: str = "CustomerID", vec: str = "x", label: str = "label",
          k: int = C.SMOTE_K, seed: int = C.SEED) -> DataFrame:
    """fit_rows ∪ synthetic minority rows (key < 0 marks synthetic rows)."""
    counts = {r[label]: r["n"] for r in fit_rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return fit_rows
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min, n_new = counts[minority], counts[majority] - counts[minority]
    if n_new <= 0:
        return fit_rows
    if n_min < k + 1:
        raise SmoteError(f"SMOTE needs at least {k + 1} minority rows, got {n_min}")
    mino = fit_rows.where(F.col(label) == minority).select(key, vec, label)
    ranked = rank_within(mino.withColumn("_h", keyed_hex(F.col(key), seed)).withColumn("_g", F.lit(0)),
                         ["_g"], F.col("_h"), F.col(key), name="brank").select(key, vec, "brank")
    nn = (knn(mino, mino, k, key, key, vec=vec, rlabel=label, exclude_self=True)
          .select(F.col("qid").alias("base_id"), F.col("rid").alias("nn_id"), F.col("rank").alias("nn_rank")))
    s = fit_rows.sparkSession.range(n_new).withColumnRenamed("id", "s")
    draws = s.select("s",
                     (F.floor(keyed_uniform(F.col("s"), seed, "base") * n_min) + 1).cast("long").alias("brank"),
                     (F.floor(keyed_uniform(F.col("s"), seed, "nn") * k) + 1).cast("int").alias("nn_rank"),
                     keyed_uniform(F.col("s"), seed, "gap").alias("u"))
    base = ranked.select(F.col(key).alias("base_id"), F.col(vec).alias("xb"), "brank")
    nbr = mino.select(F.col(key).alias("nn_id"), F.col(vec).alias("xn"))
    syn = (draws.join(base, "brank").join(nn, ["base_id", "nn_rank"]).join(nbr, "nn_id")
                .select((-(F.col("s") + 1)).alias(key),
                        F.zip_with("xb", "xn", lambda b, n: b + F.col("u") * (n - b)).alias(vec),
                        F.lit(minority).cast(fit_rows.schema[label].dataType).alias(label)))
    extra = [c for c in fit_rows.columns if c not in (key, vec, label)]
    for c in extra:
        syn = syn.withColumn(c, F.lit(None).cast(fit_rows.schema[c].dataType))
    return fit_rows.unionByName(syn.select(*fit_rows.columns))
