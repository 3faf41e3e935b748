"""Model queries (M8–M10, M20, M22, M23, S2): rows-only checks, no SQL
oracle — model fits are iterative and not expressible in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patronus.operators import compare as CMP
from patronus.operators import metrics as M
from patronus.operators import training as T
from patronus.operators.features import fit_prep
from patronus.operators.smote import smote
from patronus.plans.registry import query
from patronus.plans.training import training
from patronus.session import scratch_path
from patronus.streaming.scoring import score_with_model
from patronus.sources.customer_table import content_key
from patronus.sources.tables import tables

_MODEL_QUERIES = {
    "model_logreg": "Logistic Regression",
    "model_tree": "Decision Tree",
    "model_forest": "Random Forest",
    "model_knn": "KNN",
    "model_gbt": "Gradient Boosting",
    "model_newton_boost": "XGBoost",
}


_FINAL: dict = {}
_RUNS: dict = {}


def _kept(memo, spark, sf, make):
    """The one result a session keeps for the queries that share it: that of the last
    folder asked for, made anew when the folder's tables have changed."""
    key = (spark.sparkContext.applicationId, sf, content_key(tables(spark, sf)))
    if key not in memo:
        memo.clear()
        memo[key] = make()
    return memo[key]


def _final_plan(spark, sf):
    """The prepared final plan (train → test) for a data directory, shared
    by the single-model queries of one session (checkpointed files)."""
    return _kept(_FINAL, spark, sf, lambda: T.build_plans(training(spark, sf), cv=False)[0])


def _single(name):
    def q(spark, sf):
        res = T.train_models(_final_plan(spark, sf), [name])
        return res.predictions.where(F.col("split") == "test")
    return q


for _q, _name in _MODEL_QUERIES.items():
    query(_q)(_single(_name))


@query("smote_balance")
def q_smote(spark, sf):
    fr = training(spark, sf).where(F.col("split") == "train")
    prep = fit_prep(fr)
    fx = prep.transform(fr)
    out = smote(fx, vec="x", label="label")
    return out.select("CustomerID", "label", (F.col("CustomerID") < 0).alias("synthetic"), "x")


def full_run(spark, sf):
    """The training run for a data directory, shared by the queries that
    read its outputs (metrics, CV metrics, importances, explanation, saved
    model) within one session; its frames are checkpointed files."""
    def run():
        frame = training(spark, sf)
        plans, use_smote = T.build_plans(frame)
        res = T.train_models(plans)
        res.smote_applied, res.frame = use_smote, frame
        return res
    return _kept(_RUNS, spark, sf, run)


@query("model_metrics")
def q_model_metrics(spark, sf):
    return full_run(spark, sf).metrics


@query("cv_metrics")
def q_cv_metrics(spark, sf):
    res = full_run(spark, sf)
    return M.classification_metrics(res.predictions.where(F.col("split").isin("cv_test", "cv_train")))


@query("feature_importance")
def q_feature_importance(spark, sf):
    return CMP.feature_importance(full_run(spark, sf).importances)


@query("model_comparison")
def q_model_comparison(spark, sf):
    return CMP.explanation(full_run(spark, sf).metrics)


def _saved_run(spark, sf):
    """The training run's artefacts, written to the shared folder: (folder, training frame)."""
    res = full_run(spark, sf)
    root = scratch_path(spark, f"artifacts-{uuid.uuid4().hex}")
    T.save_artifacts(res, root, res.frame)
    return root, res.frame


@query("evaluate_saved_model")
def q_evaluate_saved(spark, sf):
    """The best model of the run, saved, loaded back and re-evaluated on
    the same keyed test split (the split is a pure function of the data)."""
    root, frame = _saved_run(spark, sf)
    return M.classification_report(T.reloaded_predictions(spark, root, frame))


@query("evaluate_saved_model_summary")
def q_evaluate_saved_summary(spark, sf):
    """Confusion matrix, rates, ROC-AUC and average precision of the reloaded model."""
    root, frame = _saved_run(spark, sf)
    return T.evaluation(T.reloaded_predictions(spark, root, frame))


@query("saved_split_info")
def q_saved_split_info(spark, sf):
    """The record of the split with the best model, read back from its document."""
    from patronus.sources.files import read_split_info_json
    root, _ = _saved_run(spark, sf)
    return read_split_info_json(spark, f"{root}/split_info").select(
        *[c for c in ("total_samples", "train_samples", "test_samples", "churn_rate_train", "churn_rate_test", "smote_applied", "cv_folds", "best_model")],
        F.array_join("features_used", ",").alias("features_used"), F.array_join("leaky_features_removed", ",").alias("leaky_features_removed"))


@query("score_customers_model")
def q_score_model(spark, sf):
    """Score every customer with the best model of the training run (by F1), saved and
    loaded as a pipeline: P(churn) and the probability risk band."""
    root, frame = _saved_run(spark, sf)
    return score_with_model(frame, T.load_pipeline(f"{root}/best_model"))
