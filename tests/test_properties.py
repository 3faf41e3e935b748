"""Property checks on the driver tables (sf0.001)."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronus.operators import metrics as M
from patronus.operators import prep as P
from patronus.operators import rfm
from patronus.operators.features import fit_prep
from patronus.operators.quantiles import quantile_row
from patronus.operators.smote import smote
from patronus.plans import evaluation as EV
from patronus.sources.tables import tables


@pytest.fixture(scope="module")
def profiles(spark, sf_small):
    return rfm.customer_profiles(tables(spark, sf_small)).toPandas()


def test_scores_and_segments(profiles):
    for c in ("R_Score", "F_Score", "M_Score"):
        assert profiles[c].between(1, 4).all()
    assert (profiles.RFM_Score == profiles.R_Score + profiles.F_Score + profiles.M_Score).all()
    assert profiles.RFM_Score.between(3, 12).all()
    assert (profiles.CLV >= 0).all()
    assert profiles.ChurnScore.between(0, 100).all()
    assert profiles.Segment.value_counts().sum() == len(profiles)
    assert profiles.CustomerID.is_unique


@pytest.mark.parametrize("per_bucket", [10**9, 50, 7])
def test_exact_quantiles_any_bucketing(spark, per_bucket):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.lognormal(4, 1.5, 3000), np.full(2000, 77.0), rng.integers(0, 9, 500)])
    pdf = pd.DataFrame({"x": vals})
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = quantile_row(spark.createDataFrame(pdf), {"x": "x"}, probs, {"x": [f"q{i}" for i in range(5)]},
                       per_bucket=per_bucket).first()
    exp = duckdb.sql("SELECT " + ", ".join(f"quantile_cont(x, {p})" for p in probs) + " FROM pdf").fetchall()[0]
    for i, e in enumerate(exp):
        assert got[f"q{i}"] == pytest.approx(e, rel=1e-12)


@pytest.fixture(scope="module")
def split(spark, sf_mid):
    lab = P.churn_label(rfm.customer_profiles(tables(spark, sf_mid)), intercept=0.0)
    return P.stratified_split(lab).toPandas()


def test_split_sizes_and_strata(split):
    n = len(split)
    test = split[split.split == "test"]
    assert len(test) == int(np.ceil(0.2 * n))
    for c, g in split.groupby("ChurnBinary"):
        share = (g.split == "test").mean()
        assert abs(share - 0.2) < 0.01


def test_folds_disjoint_and_covering(split):
    tr = split[split.split == "train"]
    assert set(tr.fold.astype(int)) == {0, 1, 2, 3, 4}
    assert split[split.split == "test"].fold.isna().all()
    sizes = tr.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 2


def test_split_is_partition_independent(spark, sf_small):
    base = P.churn_label(rfm.customer_profiles(tables(spark, sf_small)), intercept=0.0)
    a = P.stratified_split(base).select("CustomerID", "split", "fold").toPandas().sort_values("CustomerID")
    b = P.stratified_split(base.repartition(7)).select("CustomerID", "split", "fold").toPandas() \
        .sort_values("CustomerID")
    assert a.reset_index(drop=True).equals(b.reset_index(drop=True))


def test_smote_parity_and_segments(spark, sf_mid):
    prof = rfm.customer_profiles(tables(spark, sf_mid)).withColumn("Cluster", F.lit(0))
    fr = P.churn_label(prof, intercept=0.0)
    prep = fit_prep(fr)
    fx = prep.transform(fr)
    out = smote(fx, vec="x", label="label").toPandas()
    counts = out.label.value_counts()
    assert counts[0] == counts[1]
    syn = out[out.CustomerID < 0]
    orig = out[out.CustomerID >= 0]
    assert len(syn) == counts.max() - (orig.label == syn.label.iloc[0]).sum()
    # a synthetic point lies inside the box of the minority points
    mino = np.vstack(orig[orig.label == syn.label.iloc[0]].x.to_numpy())
    sx = np.vstack(syn.x.to_numpy())
    assert (sx >= mino.min(0) - 1e-9).all() and (sx <= mino.max(0) + 1e-9).all()


@pytest.fixture(scope="module")
def preds(spark, sf_mid):
    return EV.rule_predictions(spark, sf_mid)


def test_roc_monotone_and_auc_trapezoid(preds):
    test = preds.where(F.col("split") == "test")
    roc = M.roc_points(test, max_points=10**9, keep_last=True).toPandas()
    auc = {r.model: r.auc for r in M.roc_auc(test).collect()}
    for m, g in roc.groupby("model"):
        g = g.sort_values("idx")
        assert (np.diff(g.fpr) >= 0).all() and (np.diff(g.tpr) >= 0).all()
        assert (g.fpr.iloc[0], g.tpr.iloc[0]) == (0.0, 0.0)
        assert (g.fpr.iloc[-1], g.tpr.iloc[-1]) == (1.0, 1.0)
        trap = np.trapezoid(g.tpr, g.fpr)
        assert trap == pytest.approx(auc[m], abs=2e-4)


def test_metrics_partition_invariant(preds):
    a = M.classification_metrics(preds).toPandas().sort_values(["model", "split", "fold"]).reset_index(drop=True)
    b = M.classification_metrics(preds.repartition(1)).toPandas().sort_values(["model", "split", "fold"]) \
        .reset_index(drop=True)
    assert a.equals(b)


def test_profiles_invariant_to_shuffle_partitions(spark, sf_small):
    from patronus.operators import dashboards as D
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            prof = rfm.customer_profiles(tables(spark, sf_small))
            out.append((sorted(map(tuple, prof.select("CustomerID", "RFM_Score", "CLV", "Segment").collect())),
                        sorted(map(tuple, D.segment_summary(prof).collect()))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out[0] == out[1]
