"""Steps of the fits: k-means passes, cut points and the search for the best split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronus.operators import boosting as B
from patronus.operators import clusters as K
from patronus.operators.blocks import kept, sums


def test_a_kmeans_pass_is_one_stage(spark):
    """Points are kept as arrays; a pass plans nothing and shuffles nothing.  A null counts
    for no mean and its point goes to the last centre, as in ``assign_expr``."""
    rows = [(float(i % 7), float(i % 5), float(i % 3)) for i in range(300)] + [(None, 1.0, 2.0), (3.0, None, 0.0)]
    pts = spark.createDataFrame(rows, "z0 double, z1 double, z2 double").repartition(3).checkpoint(eager=True)
    centers = [[0.0, 0.0, 0.0], [3.0, 2.0, 1.0], [6.0, 4.0, 2.0]]
    data, sc = kept(pts.mapInArrow(K._pack, "n int, z binary")), spark.sparkContext
    sc.setJobGroup("one-pass", "one pass")
    got = sums(data, K._step(centers))
    (job,) = sc.statusTracker().getJobIdsForGroup("one-pass")
    assert len(sc.statusTracker().getJobInfo(job).stageIds) == 1
    data.unpersist()
    want = pts.withColumn("k", K.assign_expr(centers)).groupBy("k").agg(
        *[F.avg(f"z{j}") for j in range(3)], *[F.count(f"z{j}") for j in range(3)]).collect()
    assert {r["k"] for r in want} == set(got)
    for r in want:
        assert got[r["k"]][:3] / got[r["k"]][3:] == pytest.approx(list(r)[1:4]) and list(got[r["k"]][3:]) == list(r)[4:]


def test_cut_points_hold_sketches_not_rows(spark, monkeypatch):
    """More (plan, feature) pairs than a hash aggregation of sketches keeps: groups are plans."""
    seen = []
    frame, n = type(spark.range(0)), 150
    grouped = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *c: seen.append(c) or grouped(self, *c))
    rows = spark.range(0, 1000, 1, 4).select(F.array(*[(F.col("id") % (f + 1)).cast("double") for f in range(n)]).alias("x"))
    short = rows.select(F.slice("x", 1, 2).alias("x"))
    got = B.cut_points([rows, short], [n, 2], 4)
    assert seen == [("plan",)] and [len(g) for g in got] == [n, 2]
    for f in (0, 1, 2, 9, 149):
        want = np.quantile([i % (f + 1) for i in range(1000)], [0.25, 0.5, 0.75], method="inverted_cdf")
        assert got[0][f] == sorted(set(want.tolist()))
    assert got[1] == got[0][:2]


@pytest.mark.parametrize("how", [B.Booster(min_child_weight=0.5), B.Booster("friedman", min_leaf=2)])
def test_best_split_of_all_features_at_once(how):
    """The same split, to the last bit, as feature by feature."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        starts = np.cumsum([0, *rng.integers(1, 9, rng.integers(1, 6))])
        cols = np.sort(rng.choice(20, len(starts) - 1, replace=False))
        n = rng.integers(0, 4, starts[-1])
        hist = np.column_stack([rng.normal(size=starts[-1]) * n, rng.random(starts[-1]) * n, n])
        total, best = hist[:starts[1]].sum(0), None
        for f, a, e in zip(cols, starts[:-1], starts[1:], strict=True):
            left = hist[a:e].cumsum(0)[:-1]
            gains = how.gains(left, total) if len(left) else []
            for b, gain in enumerate(gains):
                if gain > (best[0] if best else how.least_gain):
                    best = (gain, f, b, left[b])
        got = B.best_split(hist, cols, starts, how)
        assert (got is None) == (best is None)
        assert got is None or (got[:3] == best[:3] and (got[3] == best[3]).all())


def test_models_are_trained_side_by_side(spark, monkeypatch):
    """Two fits run at the same time; results keep the order asked for."""
    from threading import Barrier
    from types import SimpleNamespace

    from patronus.operators import training as T
    both, asked = Barrier(2, timeout=60), ["Logistic Regression", "XGBoost"]

    class Model:
        featureImportances = None

    def fit(name, fits, workers):
        both.wait()
        return [Model()]
    one = spark.createDataFrame([(1, 1, 1, 0.9), (2, 0, 0, 0.2)], "CustomerID long, label int, prediction int, score double")
    monkeypatch.setattr(T, "fit_plans", fit)
    monkeypatch.setattr(T, "_predictions", lambda m, model, plan: one.select(
        F.lit(m).alias("model"), F.lit("test").alias("split"), F.lit(-1).alias("fold"), "CustomerID", "label", "prediction", "score"))
    res = T.train_models([T.Plan("final", -1, one, [], SimpleNamespace(feature_names=[]))], asked)
    assert list(res.train_time) == asked and [r["model"] for r in res.predictions.collect()] == ["Logistic Regression"] * 2 + ["XGBoost"] * 2


@pytest.mark.parametrize("how", [B.Booster(rounds=23, min_child_weight=0.5), B.Booster("friedman", rounds=23, depth=2, min_leaf=3, colsample=1.0)])
def test_plans_of_bounded_size_are_grown_in_a_task_each(spark, monkeypatch, how):
    """One job without a stage per level, and the models of the level-by-level jobs; the last columns are one-hot."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(400, 2)), np.eye(4)[rng.integers(0, 4, 400)][:, :3]])
    y = (x[:, 0] + x[:, 2] - x[:, 3] + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(400)], "CustomerID long, label int, x array<double>").repartition(3).checkpoint()
    fits, steps = [rows, rows.where("CustomerID % 3 > 0")], []
    of_steps = B.sums
    monkeypatch.setattr(B, "sums", lambda *a: steps.append(1) or of_steps(*a))
    alone = B.fit_boosters(fits, how)
    assert len(steps) == 1  # the counts of rows
    monkeypatch.setattr(B, "LOCAL_ROWS", 100)
    together = B.fit_boosters(fits, how)
    assert len(steps) > how.rounds
    for a, b in zip(alone, together, strict=True):
        assert np.allclose(a.probabilities(x), b.probabilities(x), atol=1e-9)
        assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray())


def test_one_hot_columns_are_summed_like_the_others():
    """Also where a row has two of them set, so that no one number a row stands for them."""
    rng = np.random.default_rng(6)
    edges = [[0.0, 1.0, 2.0], [0.5], [], [0.5], [0.5]]
    one = np.eye(4)[rng.integers(0, 4, 50)][:, :3].T.astype(np.uint8)
    for sets in (one, np.maximum(one, one[::-1])):
        bins = np.vstack([rng.integers(0, 4, 50), sets[0], np.zeros(50), sets[1:]]).astype(np.uint8)
        g, h, rows = rng.normal(size=50), rng.random(50), np.arange(0, 50, 2)
        cols = np.array([0, 2, 3, 4])
        starts = np.cumsum([0, *(len(edges[f]) + 1 for f in cols)])
        got = B.Features(bins, edges).sums(rows, g[rows], h[rows], cols, starts)
        for f, a, e in zip(cols, starts[:-1], starts[1:], strict=True):
            want = [[w[rows][bins[f][rows] == b].sum() for b in range(e - a)] for w in (g, h, np.ones(50))]
            assert np.allclose(got[:, a:e], want)


def test_forest_keeps_node_ids(spark):
    """The forest is the one of rows that walk all trees from their roots at every level."""
    from patronus.operators import models as MD
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(i, int(x[i, 0] + x[i, 1] > 0), x[i].tolist()) for i in range(300)], "CustomerID long, label int, x array<double>").coalesce(2)
    got = MD.fit_forest(rows)
    assert got.getOrDefault("cacheNodeIds")
    plain = MD.RandomForestClassifier(numTrees=160, maxDepth=8, minInstancesPerNode=10, featureSubsetStrategy="sqrt", maxBins=256, seed=MD.C.SEED, labelCol="label")
    assert got.toDebugString.split("\n", 1)[1] == plain.fit(MD._vec(rows)).toDebugString.split("\n", 1)[1]
