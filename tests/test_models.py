"""Model artefacts: a fitted model and its preprocessing survive a save /
load round trip and score the same; k-NN votes follow the distance rule."""

import os
import re
import tempfile
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from patronus.operators import training as T
from patronus.operators import knn as KN
from patronus.operators.knn import RefCells, knn, knn_vote, leaves, searched_share, split_tree
from patronus.operators.boosting import Booster, fit_boosters
from patronus.operators.logistic import fit_logreg_plans
from patronus.operators.models import fit_plans, scorer_of
from patronus import config as C
from patronus.plans.training import training
from patronus.sources.sinks import write_json_document


def test_save_load_scores_identically(spark, sf_small):
    plans, _ = T.build_plans(training(spark, sf_small), cv=False)
    res = T.train_models(plans, ["Decision Tree"])
    model, plan = res.models["Decision Tree"]
    path = os.path.join(tempfile.mkdtemp(prefix="patronus-model-"), "best")
    T.save_model(spark, model, plan.prep, path, "Decision Tree")
    name, scorer, prep = T.load_model(spark, path)
    assert name == "Decision Tree" and prep.onehot_cols == plan.prep.onehot_cols
    test = dict(plan.evals)["test"]
    a = {r.CustomerID: (r.prediction, r.score) for r in res.predictions.where(F.col("split") == "test").collect()}
    b = {r.CustomerID: (r.prediction, r.score) for r in scorer(test).collect()}
    assert a == b
    m = res.metrics.first()
    assert 0 <= m.accuracy <= 100 and m.train_time > 0


def test_knn_exact_and_zero_distance_vote(spark):
    ref = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [3.0, 0.0], 0), (3, [0.0, 4.0], 0), (4, [10.0, 10.0], 1)],
                                "id long, x array<double>, label int")
    q = spark.createDataFrame([(10, [0.0, 0.0]), (11, [2.0, 0.0])], "id long, x array<double>")
    nn = knn(q, ref, 2, "id", "id", slab_rows=2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.rid) for r in nn] == [(10, 1), (10, 2), (11, 2), (11, 1)]
    votes = {r.qid: (r.score, r.prediction) for r in knn_vote(knn(q, ref, 2, "id", "id")).collect()}
    assert votes[10] == (1.0, 1)                      # the zero-distance neighbour decides
    w1, w2 = 1 / 2.0, 1 / 1.0                         # id 1 at distance 2, id 2 at distance 1
    assert abs(votes[11][0] - w1 / (w1 + w2)) < 1e-12 and votes[11][1] == 0


def test_json_document_sink(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="patronus-json-"), "explanation")
    write_json_document(spark.createDataFrame([("Random Forest", 62.07)], "best_model string, f1 double"), d)
    back = spark.read.json(d).first()
    assert back.best_model == "Random Forest" and back.f1 == 62.07


def test_newton_boost_learns_and_round_trips(spark, sf_small):
    from patronus.operators import metrics as M
    plans, _ = T.build_plans(training(spark, sf_small), cv=False)
    plan = plans[0]
    m = fit_boosters([plan.fit], Booster(rounds=5))[0]
    assert len(m.trees) == 5 and abs(sum(m.featureImportances.toArray()) - 1) < 1e-9
    fx = plan.fit
    p = m.scorer()(fx).join(fx.select("CustomerID", "label"), "CustomerID") \
        .select(F.lit("nb").alias("model"), F.lit("train").alias("split"), F.lit(-1).alias("fold"),
                "CustomerID", "label", "prediction", "score")
    assert M.roc_auc(p).first().auc > 0.6
    path = os.path.join(tempfile.mkdtemp(prefix="patronus-nb-"), "best")
    T.save_model(spark, m, plan.prep, path, "XGBoost")
    _, scorer, _ = T.load_model(spark, path)
    a = {r.CustomerID: r.score for r in m.scorer()(fx).collect()}
    b = {r.CustomerID: r.score for r in scorer(fx).collect()}
    assert a == b


def test_artifacts_and_importance_choice(spark, sf_small):
    from patronus.operators import compare as CMP
    from patronus.sources import files
    frame = training(spark, sf_small)
    plans, _ = T.build_plans(frame, cv=False)
    res = T.train_models(plans, ["Decision Tree", "Random Forest"])
    root = tempfile.mkdtemp(prefix="patronus-art-")
    best = T.save_artifacts(res, root, frame)
    assert best in ("Decision Tree", "Random Forest")
    for t in ("model_metrics", "feature_importance", "confusion_matrix", "roc_points"):
        assert spark.read.parquet(os.path.join(root, t)).count() > 0
    info = files.read_split_info_json(spark, os.path.join(root, "split_info")).first()
    assert (info.best_model, info.features_used, info.leaky_features_removed) == (best, C.ALL_FEATURES, C.LEAKY_REPORTED)
    assert info.total_samples == info.train_samples + info.test_samples == frame.count()
    assert [r.feature for r in files.read_feature_list(spark, os.path.join(root, "features")).orderBy("order").collect()] == C.ALL_FEATURES
    doc = files.read_explanation_json(spark, os.path.join(root, "explanation")).first()
    assert doc.best_model == best and set(doc.overfit_models) | set(doc.clean_models) == {"Decision Tree", "Random Forest"}
    # the reloaded model's evaluation is that of the run
    again = T.evaluation(T.reloaded_predictions(spark, root, frame)).first()
    ran = res.metrics.where(F.col("model") == best).first()
    assert (again.accuracy, again.precision, again.recall, again.f1) == (ran.accuracy, ran.precision, ran.recall, ran.f1)
    assert round(again.auc * 100, 2) == pytest.approx(ran.auc, abs=0.011) and 0 < again.average_precision <= 1
    assert again.tn + again.fp + again.fn + again.tp == info.test_samples
    fi = CMP.feature_importance(res.importances).collect()
    assert {r.model for r in fi} == {"Random Forest"}          # first in the importance order
    assert [r.rank for r in fi] == list(range(1, len(fi) + 1))
    assert abs(sum(r.importance for r in fi) - 1) < 1e-9


def test_knn_searches_a_falling_share(spark):
    """Cells of a fixed size: more rows, more cells, a smaller share of all pairs searched."""
    rng, shares = np.random.default_rng(3), []
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id long, x array<double>")
    at = np.array([r.x for r in q.orderBy("id").collect()])
    for n in (1_000, 4_000, 16_000):
        x = rng.normal(size=(n, 4))
        ref = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "id long, x array<double>, label int").coalesce(4)
        cells = RefCells(ref, "id", slab_rows=64)
        shares.append(searched_share(q, cells, 5, "id"))
        got = knn(q, None, 5, "id", "id", prepared=cells).orderBy("qid", "rank").collect()
        want = np.argsort(((at[:, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :5]
        assert [r.rid for r in got] == want.ravel().tolist()
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.15, shares


def test_split_tree_halves_every_cell():
    x = np.random.default_rng(5).normal(size=(4096, 3)) * [1, 5, 2]
    coord, cut = split_tree(x, 5)
    assert coord[0] == 1 and (np.bincount(leaves(x, coord, cut), minlength=32) == 128).all()
    same = np.ones((50, 2))                       # equal rows can't be split: one leaf has them all
    assert len(set(leaves(same, *split_tree(same, 3)))) == 1
    assert set(leaves(x[:3], *split_tree(x[:0], 2))) == {0}


@pytest.mark.parametrize("slab_rows,exclude_self", [(10**6, False), (37, False), (11, True)])
def test_knn_matches_brute_force(spark, slab_rows, exclude_self):
    rng = np.random.default_rng(7)
    n, d, k = 400, 5, 6
    x = rng.normal(size=(n, d))
    x[:120, 0] = 0.25                        # a hot coordinate value: one big slab
    x[200:210] = x[210:220]                  # exact duplicates (distance ties)
    y = rng.integers(0, 2, n)
    ref = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)],
                                "id long, x array<double>, label int")
    got = knn(ref, ref, k, "id", "id", slab_rows=slab_rows, exclude_self=exclude_self) \
        .select("qid", "rid", "rank").toPandas()
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(dist, np.inf)
    for q in range(n):
        order = sorted(range(n), key=lambda j: (dist[q, j], j))[:k]
        mine = got[got.qid == q].sort_values("rank").rid.tolist()
        assert mine == order, q


def test_knn_block_memory_and_bound():
    """A group of two full chunks is searched in a few MB; rows beyond a query's bound stay out,
    those exactly at it do not."""
    rng = np.random.default_rng(13)
    x = rng.integers(0, 500, (4096, 4)).astype(float)
    q = pd.DataFrame({"qid": np.arange(4096), "qx": list(x), "rk": np.inf})
    r = pd.DataFrame({"rid": np.arange(4096), "rx": list(x), "rlabel": 0})
    tracemalloc.start()
    got = KN._local_topk(5, False)(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 5 * 4096 and peak < 40e6, peak
    third = got.groupby("qid").dist.nth(2).to_numpy()
    near = KN._local_topk(5, False)(q.assign(rk=third), r)
    limit = dict(zip(q.qid, third, strict=True))
    assert 3 * 4096 <= len(near) < len(got) and (near.dist <= near.qid.map(limit) * (1 + 1e-9)).all()


def test_knn_tasks_follow_the_rows(spark, monkeypatch):
    """The shuffle into cell groups has a task per ``TASK_ROWS`` rows, not one per so many MB."""
    rng = np.random.default_rng(17)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 2) for i in range(3000)], "id long, x array<double>, label int").coalesce(2)
    usual = sorted(map(tuple, knn(rows, rows, 4, "id", "id", slab_rows=128).collect()))
    monkeypatch.setattr(KN, "TASK_ROWS", 100)
    few = knn(rows, rows, 4, "id", "id", slab_rows=128)
    plan = few._jdf.queryExecution().executedPlan().toString()
    tasks = {int(t) for t in re.findall(r"hashpartitioning\([^)]*s#[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert len(tasks) == 1 and tasks.pop() > 20
    assert sorted(map(tuple, few.collect())) == usual


@pytest.fixture(scope="module")
def two_clouds(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 240)
    x = rng.normal(size=(240, 3)) + y[:, None]
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(240)],
                                 "CustomerID long, label int, x array<double>").coalesce(1).cache()


@pytest.mark.parametrize("name", C.MODEL_NAMES)
def test_every_classifier_fits_and_scores(two_clouds, name):
    model, half = fit_plans(name, [two_clouds, two_clouds.where("CustomerID % 2 = 0")])
    assert scorer_of(half)(two_clouds).count() == 240
    got = scorer_of(model)(two_clouds).join(two_clouds, "CustomerID").toPandas()
    assert len(got) == 240 and got.score.between(0, 1).all()
    assert (got.prediction == got.label).mean() > 0.7


def brute_logistic(x, y, c=0.8):
    """Newton steps in plain numpy, from another start."""
    n, z = len(y), np.column_stack([x, np.ones(len(y))])
    s = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    ridge, w = np.append(np.ones(x.shape[1]), 0.0), np.full(z.shape[1], 0.1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(c * z.T @ (z * (s * p * (1 - p))[:, None]) + np.diag(ridge), c * z.T @ (s * (p - y)) + ridge * w)
    return w


def test_logistic_plans_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    fits, want = [], []
    for n, d in ((300, 4), (120, 2), (40, 3)):
        x = rng.normal(size=(n, d))
        y = (x[:, 0] * 3 + rng.normal(size=n) > 1).astype(int)
        fits.append(spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "CustomerID long, label int, x array<double>"))
        want.append(brute_logistic(x, y))
    for m, w in zip(fit_logreg_plans(fits), want, strict=True):
        assert np.allclose([*m.coefficients, m.intercept], w, atol=1e-6)


def brute_boosting(x, y, how):
    """The same trees by plain loops over sorted values (no row or column draws)."""
    base = np.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), base)
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth):
            best = None
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[1:]:
                    left, right = rows[x[rows, j] < cut], rows[x[rows, j] >= cut]
                    if min(len(left), len(right)) < how.min_leaf:
                        continue
                    if how.kind == "friedman":
                        gain = len(left) * len(right) / len(rows) * (g[left].mean() - g[right].mean()) ** 2
                    else:
                        if min(h[left].sum(), h[right].sum()) < how.min_child_weight:
                            continue
                        rate = lambda r: max(abs(g[r].sum()) - how.alpha, 0) ** 2 / (h[r].sum() + how.lam)
                        gain = rate(left) + rate(right) - rate(rows)
                    if gain > (how.gamma if how.kind == "newton" else 1e-12) and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
            if depth and best:
                grow(best[1], depth - 1)
                grow(best[2], depth - 1)
            elif how.kind == "friedman":
                margin[rows] += how.eta * -g[rows].sum() / h[rows].sum()
            else:
                margin[rows] += how.eta * -np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - how.alpha, 0) / (h[rows].sum() + how.lam)
        grow(np.arange(len(y)), how.depth)
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("how", [Booster(rounds=25, depth=3, eta=0.3, subsample=1, colsample=1),
                                 Booster("friedman", rounds=25, depth=2, eta=0.3, subsample=1, colsample=1, min_leaf=15)])
def test_boosters_equal_brute_force(spark, how):
    """Two plans of 200 and 150 rows, all values cut points; the 21st round starts from written margins."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    x[:, 2] = rng.integers(0, 3, 200)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=200) > 0.5).astype(float)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(200)], "CustomerID long, label int, x array<double>")
    models = fit_boosters([rows, rows.where("CustomerID < 150")], how)
    for m, n in zip(models, (200, 150), strict=True):
        got = m.scorer()(rows).orderBy("CustomerID").toPandas().score.to_numpy()
        assert np.allclose(got[:n], brute_boosting(x[:n], y[:n], how), atol=1e-9)


def test_a_tree_by_hand(spark):
    """Four rows, margin 0: g = ±1/2, h = 1/4.  The cut at 2 gives 2 · (1 − 0.1)² / (0.5 + 1) − 0 = 1.08
    and leaves ∓0.9 / 1.5 = ∓0.6."""
    rows = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.5]), (3, 1, [2.0]), (4, 1, [9.0])], "CustomerID long, label int, x array<double>")
    how = Booster(rounds=1, depth=1, eta=1.0, subsample=1, colsample=1, min_child_weight=0.1, alpha=0.1, lam=1.0, gamma=1.0)
    m = fit_boosters([rows], how)[0]
    (t,) = m.trees
    assert m.base_margin == 0 and m.edges[0][t.threshold[0]] == 2.0 and np.allclose(t.leaf, [-0.6, 0.6])
    assert fit_boosters([rows], Booster(**{**how.__dict__, "gamma": 1.09}))[0].trees[0].feature == [-1]


def test_preparation_of_all_plans_from_fold_counts(spark):
    """Equal to each plan's own fit, with missing values, ties, a rare bucket, and buckets of few values."""
    import pandas as pd
    from patronus.operators.features import FINAL, fit_preps
    rng = np.random.default_rng(12)
    n = 500
    pdf = pd.DataFrame({"CustomerID": range(n), "ChurnBinary": rng.integers(0, 2, n), "fold": rng.integers(0, 5, n),
                        "Country": rng.choice(["A", "B", "C", "D", "E", None], n, p=[0.3, 0.3, 0.2, 0.11, 0.04, 0.05])})
    for j, c in enumerate(C.NUMERIC_FEATURES):
        pdf[c] = np.where(rng.random(n) < 0.1, np.nan, np.round(rng.normal(1e6 * j, 3, n), j % 3))
    pdf["Cluster"] = 2.0
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, "CustomerID long, ChurnBinary int, fold int, Country string, " + ", ".join(f"{c} double" for c in C.NUMERIC_FEATURES))
    for per_bucket in (2_000_000, 40):
        preps = fit_preps(df, 5, 0.1, per_bucket=per_bucket)
        assert list(preps) == [FINAL, *range(5)]
        for p, prep in preps.items():
            fit = pdf[pdf.fold != p]
            for c in C.NUMERIC_FEATURES:
                v = fit[c].fillna(fit[c].median())
                assert prep.medians[c] == fit[c].median()
                assert np.isclose(prep.means[c], v.mean(), rtol=1e-12) and np.isclose(prep.deviations[c], v.std(ddof=0), rtol=1e-9, atol=1e-12)
            count = fit.Country.value_counts()
            mode = min(count.index, key=lambda s: (-count[s], s))
            count = fit.Country.fillna(mode).value_counts()
            kept = sorted(s for s in count.index if count[s] >= 0.1 * len(fit))
            assert (prep.mode, prep.kept, prep.has_rare) == (mode, kept, len(kept) < len(count))
    x = preps[0].transform(df).toPandas()
    assert len(x) == n and {len(v) for v in x.x} == {7 + len(preps[0].onehot_cols)}


def test_many_categories_are_counted_not_collected(spark):
    """10⁵ categories: only what is kept reaches the driver, and the fit has no window over them."""
    from patronus.operators.features import FINAL, fit_preps
    df = spark.range(120_000).select(F.when(F.col("id") < 20_000, "big").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("Country"))
    prep = fit_preps(df, 0, 0.01, numeric=[])[FINAL]
    assert (prep.mode, prep.kept, prep.has_rare, prep.onehot_cols) == ("big", ["big"], True, [C.RARE_BUCKET])
    got = df.select(prep.onehot_column().alias("c")).groupBy("c").count().collect()
    assert sorted((r["c"], r["count"]) for r in got if r["c"]) == [(C.RARE_BUCKET, 100_000)]


def test_a_step_is_one_stage_and_adds_the_same_by_shuffle(spark, monkeypatch):
    """Few rows make few tasks; a step plans nothing and needs no shuffle below ``DIRECT`` tasks."""
    from patronus.operators import blocks as B
    rows = spark.range(0, 500, 1, 4).select(F.col("id").alias("CustomerID"), (F.col("id") % 2).cast("int").alias("label"),
                                            F.array(F.rand(1), F.rand(2)).alias("x")).checkpoint(eager=True)
    assert B.kept(B.blocks([rows])).getNumPartitions() == 1

    def add(block, held):
        held[block["plan"]] = held.get(block["plan"], 0) + block["x"].reshape(-1, 2).sum(0)
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    data, sc = B.kept(B.blocks([rows, rows.where("label = 1")])), spark.sparkContext
    assert data.getNumPartitions() == 4
    sc.setJobGroup("one-step", "one step")
    direct = B.sums(data, add)
    (job,) = sc.statusTracker().getJobIdsForGroup("one-step")
    assert len(sc.statusTracker().getJobInfo(job).stageIds) == 1
    monkeypatch.setattr(B, "DIRECT", 1)
    shuffled = B.sums(data, add)
    assert direct.keys() == shuffled.keys() == {0, 1} and all((direct[k] == shuffled[k]).all() for k in direct)
    data.unpersist()


@pytest.fixture(scope="module")
def towns(spark):
    """Rows with a one-hot column per town and four numbers; some are between two towns, some come twice."""
    rng = np.random.default_rng(23)
    x = np.column_stack([rng.normal(size=(4000, 4)), np.eye(9)[rng.integers(0, 9, 4000)][:, 1:]])
    x[:40, 4:] = (x[:40, 4:] + x[40:80, 4:]) / 2
    x[300:340] = x[340:380]
    return x, spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "id long, x array<double>, label int").coalesce(4).checkpoint()


def test_knn_searches_one_town(spark, towns):
    """Cells hold one combination of two-valued coordinates; the neighbours are those of brute force,
    also for a combination and for values that no reference row has."""
    x, ref = towns
    ask = np.vstack([x[:60], x[1000:1100], np.r_[9.0, 0, 0, 0, np.ones(8)], np.full(12, 0.5)])
    q = spark.createDataFrame(list(enumerate(ask.tolist())), "id long, x array<double>")
    cells = RefCells(ref, "id", slab_rows=64)
    share = searched_share(q.where("id >= 60 and id < 160"), cells, 5, "id")
    assert share < 0.15, share
    d = np.sqrt(((ask[:, None] - x[None]) ** 2).sum(-1))
    want = [sorted(range(4000), key=lambda j: (d[i, j], j))[:5] for i in range(len(ask))]
    got = knn(q, None, 5, "id", "id", prepared=cells).orderBy("qid", "rank").collect()
    assert [r.rid for r in got] == sum(want, [])


@pytest.mark.parametrize("slab_rows", [64, 10**6])
def test_knn_of_reference_rows_takes_those_at_distance_zero_alone(spark, towns, slab_rows):
    """Less is searched and kept, and the vote is that of all neighbours."""
    _, ref = towns
    q = ref.select("id", "x").where("id < 400").unionByName(ref.where("id < 50").selectExpr("id + 10000 as id", "transform(x, v -> v + 0.01) as x"))
    cells = RefCells(ref, "id", slab_rows=slab_rows)
    few, all_ = (knn(q, None, 5, "id", "id", prepared=cells, zero_alone=z) for z in (True, False))
    assert few.where("qid < 400").count() == 480 and all_.count() == 5 * 450 and few.where("qid >= 10000").count() == 250
    votes = [{r.qid: (r.score, r.prediction) for r in knn_vote(n).collect()} for n in (few, all_)]
    assert votes[0] == votes[1]
