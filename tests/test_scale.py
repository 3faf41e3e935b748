"""Large counts, crowded values and convergence."""

import pytest
from pyspark.sql import functions as F

from patronus.operators import clusters as K
from patronus.operators import compare as CMP
from patronus.operators import metrics as M
from patronus.operators import rfm
from patronus.operators.quantiles import quantile_row
from patronus.sources.tables import tables


def test_kmeans_is_a_fixpoint(spark, sf_mid):
    """One more assignment and update changes no customer's cluster."""
    base = rfm.customer_base(tables(spark, sf_mid)).checkpoint(eager=True)
    centers, means, stds = K.fit(base)
    z = [K._z(c, means[j], stds[j]).alias(f"z{j}") for j, c in enumerate(K.FEATURES)]
    pts = base.select("CustomerID", *z).withColumn("k", K.assign_expr(centers))
    new = [list(c) for c in centers]
    for r in pts.groupBy("k").agg(*[F.avg(f"z{j}").alias(f"c{j}") for j in range(3)]).collect():
        new[r["k"]] = [r["c0"], r["c1"], r["c2"]]
    assert pts.where(K.assign_expr(new) != F.col("k")).count() == 0


def test_kmeans_without_convergence_is_an_error(spark, sf_small):
    with pytest.raises(RuntimeError):
        K.fit(rfm.customer_base(tables(spark, sf_small)), safety=1)


def test_metrics_of_billions(spark, monkeypatch):
    """3e9 positives and negatives: products of counts exceed 64 bits."""
    n = 3_000_000_000
    points = spark.createDataFrame([("m", "test", -1, 0.2, 0, n, 0, n, 1, n, n, 2), ("m", "test", -1, 0.8, n, 0, n, n, 2, n, n, 2)],
                                   "model string, split string, fold int, score double, pos long, neg long, cpos long, cneg long, "
                                   "cdist long, P long, N long, D long")
    monkeypatch.setattr(M, "score_points", lambda preds, group=M.GROUP: points)
    assert M.roc_auc(None).first()["auc"] == 1.0
    assert M.average_precision(None).first()["average_precision"] == 1.0


def test_crowded_scores_spread(spark, monkeypatch):
    seen = {}
    real = M.two_level

    def spy(df, group, bucket, order, values):
        seen.setdefault("n", sorted(r[1] for r in df.groupBy(bucket).count().collect()))
        return real(df, group, bucket, order, values)
    monkeypatch.setattr(M, "two_level", spy)
    preds = spark.range(20_000).select(F.lit("m").alias("model"), F.lit("test").alias("split"), F.lit(-1).alias("fold"),
                                       (F.col("id") % 2).cast("int").alias("label"), (0.10 + F.col("id") / 2e6).alias("score"))
    M.score_points(preds).count()
    assert max(seen["n"]) <= 3 * sum(seen["n"]) / len(seen["n"]) and len(seen["n"]) > 200


def test_quantile_buckets_are_even(spark):
    """The boundaries cover the whole distribution, the last bucket included."""
    df = spark.range(65_000).select((F.col("id") * 1.5).alias("v"))
    row = quantile_row(df, {"v": "v"}, [0.25, 0.5, 0.99], per_bucket=100)
    assert [round(x, 6) for x in row.first()] == [round(p * 64_999 * 1.5, 6) for p in (0.25, 0.5, 0.99)]
    cuts = df.agg(F.percentile_approx("v", [i / 1024 for i in range(1, 1024)], 10000)).first()[0]
    splits = [cuts[round(i * 1024 / 650) - 1] for i in range(1, 650)]
    sizes = [b - a for a, b in zip([0, *splits], [*splits, 65_000 * 1.5])]
    assert max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_explanation_when_all_models_overfit(spark):
    rows = [("Random Forest", 80.0, 60.0, 70.0, 65.0, 82.0, 79.0, 20.0, 0), ("KNN", 70.0, 50.0, 60.0, 55.0, 72.0, 69.0, 15.0, 1)]
    m = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, auc double, "
                                    "cv_accuracy double, generalization_gap double, `order` int")
    r = CMP.explanation(m).first()
    assert r["clean_models"] == "" and "prefer Random Forest" in r["overfitting_analysis"]


def test_large_line_items_are_dealt_by_their_count(spark, sf_small, monkeypatch):
    """Beyond ``ROWS_PER_TASK`` rows a task the shuffles' tasks follow the rows; the customers stay the same."""
    t = tables(spark, sf_small)
    assert rfm.order_tasks(t) is None
    before = sorted(map(tuple, rfm.customer_base(t).collect()))
    monkeypatch.setattr(rfm, "ROWS_PER_TASK", 500)
    tasks = rfm.order_tasks(t)
    assert tasks >= t.read("lineitem").count() / 500 > spark.sparkContext.defaultParallelism
    base = rfm.customer_base(t)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, base.collect())) == before and len(before) > 0
