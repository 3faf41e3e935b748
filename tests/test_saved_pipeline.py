"""The saved model is a Spark ML pipeline: loaded again, in another session too, it
scores tables and streams as the fitted classifier does."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from patronus import config as C
from patronus.operators import training as T
from patronus.operators.boosting import Booster, fit_boosters
from patronus.operators.models import fit_plans, scorer_of
from patronus.plans import models as PM
from patronus.plans.training import training
from patronus.streaming.scoring import feature_schema, score_with_model

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COLUMNS = ["CustomerID", *C.ALL_FEATURES]
FRESH = """
import json, sys
from patronus.session import get_spark
from patronus.operators.training import load_pipeline
spark = get_spark("local[1]")
rows = load_pipeline(sys.argv[1]).transform(spark.read.parquet(sys.argv[2])).select("CustomerID", "score").collect()
print("SCORES" + json.dumps({r.CustomerID: r.score for r in rows}))
"""


@pytest.fixture(scope="module")
def plan(spark, sf_small):
    return T.build_plans(training(spark, sf_small), cv=False)[0][0]


@pytest.fixture(scope="module")
def customers(spark, sf_small, tmp_path_factory):
    """Raw features of the test customers, without label; two rows have gaps."""
    path = str(tmp_path_factory.mktemp("customers") / "rows")
    rows = training(spark, sf_small).where("split = 'test'").select(*COLUMNS)
    odd = spark.createDataFrame([(-1, *[None] * 7, None), (-2, *[1.0] * 7, "nowhere")], feature_schema())
    kinds = {f.name: f.dataType for f in feature_schema()}
    rows = rows.select(*[F.col(c).cast(kinds[c]) for c in feature_schema().names]).unionByName(odd)
    rows.coalesce(2).write.parquet(path)
    return path


def model_of(name, plan):
    if name == "XGBoost":
        return fit_boosters([plan.fit], Booster(rounds=4))[0]
    return fit_plans(name, [plan.fit])[0]


@pytest.mark.parametrize("name", ["Logistic Regression", "XGBoost", "Decision Tree", "KNN"])
def test_saved_pipelines_score_as_fitted(spark, plan, customers, tmp_path, name):
    model = model_of(name, plan)
    path = str(tmp_path / "best")
    T.save_model(spark, model, plan.prep, path, name)
    pipeline, table = T.load_pipeline(path), spark.read.parquet(customers)
    got = {r.CustomerID: (r.score, r.prediction) for r in pipeline.transform(table).collect()}
    x = plan.prep.with_x(table)
    want = {r.CustomerID: (r.score, r.prediction) for r in scorer_of(model)(x).collect()}
    assert got == want and len(got) == table.count() and {-1, -2} <= set(got)
    assert pipeline.transform(table.where("false")).count() == 0
    kept = score_with_model(table.withColumn("label", F.lit("own")), pipeline)
    assert kept.columns == ["CustomerID", "churn_probability", "churn_risk", "model_used"]
    assert {r.model_used for r in kept.collect()} == {name}
    if name == "KNN":
        with pytest.raises(ValueError, match="streams"):
            pipeline.transform(spark.readStream.schema(feature_schema()).parquet(customers))
        return
    stream = spark.readStream.schema(feature_schema()).parquet(customers)
    q = score_with_model(stream, pipeline).writeStream.format("memory").queryName("scored_" + name[:3]).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(spark.table("scored_" + name[:3]).collect()) == sorted(score_with_model(table, pipeline).collect())


def test_a_fresh_session_loads_the_pipeline(spark, plan, customers, tmp_path):
    path = str(tmp_path / "best")
    T.save_model(spark, model_of("Decision Tree", plan), plan.prep, path, "Decision Tree")
    out = subprocess.run([sys.executable, "-c", FRESH, path, customers], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True).stdout
    fresh = {int(k): v for k, v in json.loads(out.split("SCORES")[1]).items()}
    here = T.load_pipeline(path).transform(spark.read.parquet(customers)).select("CustomerID", "score").collect()
    assert fresh == {r.CustomerID: r.score for r in here}


def test_saved_queries_make_the_training_frame_once(spark, sf_small, monkeypatch):
    """The run's own frame is split, saved and evaluated; it is not computed a second time."""
    made, build, train = [], T.build_plans, T.train_models
    monkeypatch.setattr(PM, "training", lambda *a: made.append(training(*a)) or made[-1])
    monkeypatch.setattr(PM, "_RUNS", {})
    monkeypatch.setattr(T, "build_plans", lambda frame: build(frame, cv=False))
    monkeypatch.setattr(T, "train_models", lambda plans: train(plans, ["Decision Tree"]))
    r = PM.q_saved_split_info(spark, sf_small).first()
    assert len(made) == 1 and r.best_model == "Decision Tree"
    assert r.total_samples == made[0].count() and r.test_samples == made[0].where("split = 'test'").count()
