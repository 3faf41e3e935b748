"""The training run (M7–M10, M17, M20–M23, A8, A9): per-fold preparation,
SMOTE on fit rows, six classifiers, predictions, metrics and artefacts.

Plans: the final plan (fit = all train rows; evaluate 'test' and 'train') and five CV
plans (fit = train rows outside fold f; evaluate the fold as 'cv_test' and the fit rows
as 'cv_train').  All plans' preparation comes from one set of per-fold statistics
(``features``) and is a projection of the one written frame; only the over-sampled fit
rows are written again.  Boosting and logistic regression fit all plans in the same
jobs, the others plan by plan from a small thread pool; ``SIDE_BY_SIDE`` models are
trained at a time.

``train_time`` is the span the reference times for one model: preparation and SMOTE of
the six plans (done once for all models, and counted in each one's time), the six fits
and the scoring, while other models are trained beside it.
"""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronus import config as C
from patronus.functions.numeric import rnd
from patronus.operators import metrics as M
from patronus.operators.compare import explanation_document
from patronus.operators.features import FINAL, Prepared, fit_preps
from patronus.operators.models import KnnModel, fit_plans, importances, scorer_of
from patronus.operators.pipeline import pipeline_model, scorer
from patronus.operators.smote import needs_smote, smote
from patronus.sources.sinks import write_json_document, write_list_document

SIDE_BY_SIDE = 4
LONGEST = ("Random Forest", "XGBoost", "KNN", "Gradient Boosting")


@dataclass
class Plan:
    name: str
    fold: int
    fit: DataFrame                       # prepared (+ SMOTE) fit rows
    evals: list[tuple[str, DataFrame]]   # (split name, prepared rows)
    prep: Prepared | None = None
    seconds: float = 0.0                 # preparation and SMOTE of all plans


@dataclass
class TrainResult:
    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame
    train_time: dict[str, float]
    models: dict = field(default_factory=dict)
    plans: list = field(default_factory=list)
    smote_applied: bool = False
    frame: DataFrame | None = None       # the training frame, where the caller keeps it


def build_plans(frame: DataFrame, folds: int = C.CV_FOLDS, workers: int = 6,
                min_frequency: float = C.ONEHOT_MIN_FREQUENCY, cv: bool = True) -> tuple[list[Plan], bool]:
    """frame: training_frame output (CustomerID, features, ChurnBinary, split, fold),
    already written.  The final plan comes first."""
    t0 = time.time()
    tr = frame.where(F.col("split") == "train")
    te = frame.where(F.col("split") == "test")
    preps = fit_preps(tr, folds if cv else 0, min_frequency)
    use_smote = needs_smote(tr, "ChurnBinary")

    def plan(f: int) -> Plan:
        prep, fit = preps[f], tr if f == FINAL else tr.where(F.col("fold") != f)
        fx = prep.transform(fit)
        if f == FINAL:
            name, evals = "final", [("test", prep.transform(te)), ("train", fx)]
        else:
            name, evals = f"cv{f}", [("cv_test", prep.transform(tr.where(F.col("fold") == f))), ("cv_train", fx)]
        return Plan(name, f, smote(fx, vec="x", label="label").checkpoint(eager=True) if use_smote else fx, evals, prep)
    with ThreadPoolExecutor(max_workers=workers) as ex:
        plans = list(ex.map(plan, preps))
    for p in plans:
        p.seconds = time.time() - t0
    return plans, use_smote


def _predictions(model_name: str, model, plan: Plan) -> DataFrame:
    sc = scorer_of(model)
    outs = []
    for split, ev in plan.evals:
        p = sc(ev).join(ev.select("CustomerID", "label"), "CustomerID")
        outs.append(p.select(F.lit(model_name).alias("model"), F.lit(split).alias("split"),
                             F.lit(plan.fold).cast("int").alias("fold"),
                             "CustomerID", "label", "prediction", "score"))
    return outs[0].unionByName(outs[1]).checkpoint(eager=True)


def train_models(plans: list[Plan], models: list[str] | None = None, workers: int = 6) -> TrainResult:
    models = models or list(C.MODEL_NAMES)
    spark = plans[0].fit.sparkSession

    def one(m: str) -> tuple[float, list, list[DataFrame]]:
        t0 = time.time()
        found = fit_plans(m, [p.fit for p in plans], workers)
        with ThreadPoolExecutor(max_workers=workers) as ex:
            out = list(ex.map(lambda x: _predictions(m, x[0], x[1]), zip(found, plans, strict=True)))
        return round(plans[0].seconds + time.time() - t0, 3), found, out
    # some fits are chains of short jobs or a task a plan and fill few cores: some models at a time, the longest first
    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as ex:
        running = {m: ex.submit(one, m) for m in sorted(models, key=lambda m: m not in LONGEST)}
    done = {m: running[m].result() for m in models}
    times = {m: done[m][0] for m in models}
    fitted = {m: (done[m][1][0], plans[0]) for m in models}
    preds = [p for m in models for p in done[m][2]]
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    order = F.create_map(*[x for i, n in enumerate(C.MODEL_NAMES) for x in (F.lit(n), F.lit(i))])
    tt = spark.createDataFrame([(k, float(v)) for k, v in times.items()], "model string, train_time double")
    met = (M.model_metrics(allp, C.OVERFIT_GAP_PP).join(F.broadcast(tt), "model", "left")
           .withColumn("order", order[F.col("model")]))
    rows = []
    for m, (model, plan) in fitted.items():
        fi = importances(model, plan.prep.feature_names)
        if fi:
            rows += [(m, n, v) for n, v in fi]
    imp = spark.createDataFrame(rows, "model string, feature string, importance double")
    return TrainResult(allp, met, imp, times, fitted, plans)


def best_model_name(metrics: DataFrame) -> str:
    """Best by F1, first in listing order on ties (a ≤ 6-row frame)."""
    r = metrics.orderBy(F.col("f1").desc(), F.col("order")).select("model").first()
    return r["model"]


# --- A8 / A9: artefacts ---------------------------------------------------------------------

def split_record(frame: DataFrame, smote_applied: bool, best_model: str, folds: int = C.CV_FOLDS) -> DataFrame:
    """One row on the split that was trained on and the model chosen."""
    y, tr, te = F.col("ChurnBinary"), F.col("split") == "train", F.col("split") == "test"
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    return frame.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(tr).alias("train_samples"), F.count_if(te).alias("test_samples"),
        rnd(F.avg(F.when(tr, y)) * 100, 1).alias("churn_rate_train"), rnd(F.avg(F.when(te, y)) * 100, 1).alias("churn_rate_test")).select(
        "*", names(C.ALL_FEATURES).alias("features_used"), names(C.LEAKY_REPORTED).alias("leaky_features_removed"),
        F.lit(smote_applied).alias("smote_applied"), F.lit(folds).alias("cv_folds"), F.lit(best_model).alias("best_model"))


def evaluation(preds: DataFrame) -> DataFrame:
    """Per (model, split, fold) the confusion matrix, accuracy, precision, recall, F1
    (percent), ROC-AUC and average precision (fractions)."""
    keys = ["model", "split", "fold"]
    counts = M.confusion_matrix(preds).select(*keys, "tn", "fp", "fn", "tp")
    out = counts.join(M.classification_metrics(preds), keys)
    return out.join(M.roc_auc(preds).select(*keys, "auc"), keys, "left").join(M.average_precision(preds), keys, "left")


def reloaded_predictions(spark: SparkSession, root: str, frame: DataFrame) -> DataFrame:
    """The test rows of ``frame`` scored by the model saved under ``root``."""
    name, scorer, prep = load_model(spark, os.path.join(root, "best_model"))
    x = prep.transform(frame.where(F.col("split") == "test"))
    return scorer(x).join(x.select("CustomerID", "label"), "CustomerID").select(
        F.lit(name).alias("model"), F.lit("test").alias("split"), F.lit(-1).alias("fold"), "CustomerID", "label", "prediction", "score")


def save_artifacts(result: TrainResult, root: str, frame: DataFrame | None = None) -> str:
    """Write the long artefact tables, the documents (explanation, feature list and, given
    the training frame, the split's record) and the best model (classifier + fitted
    preprocessing) under ``root``; returns the best model's name."""
    result.metrics.write.mode("overwrite").parquet(os.path.join(root, "model_metrics"))
    result.importances.write.mode("overwrite").parquet(os.path.join(root, "feature_importance"))
    cm = M.confusion_matrix(result.predictions.where(F.col("split") == "test"))
    cm.write.mode("overwrite").parquet(os.path.join(root, "confusion_matrix"))
    M.roc_points(result.predictions.where(F.col("split") == "test")).write.mode("overwrite") \
        .parquet(os.path.join(root, "roc_points"))
    best = best_model_name(result.metrics)
    spark = result.metrics.sparkSession
    write_json_document(explanation_document(result.metrics), os.path.join(root, "explanation"))
    write_list_document(C.ALL_FEATURES, spark, os.path.join(root, "features"))
    if frame is not None:
        write_json_document(split_record(frame, result.smote_applied, best, max(1, len(result.plans) - 1)), os.path.join(root, "split_info"))
    model, plan = result.models[best]
    save_model(spark, model, plan.prep, os.path.join(root, "best_model"), best)
    return best


def save_model(spark: SparkSession, model, prep: Prepared, path: str, name: str) -> None:
    rows = os.path.join(path, "rows")
    if isinstance(model, KnnModel):
        model.fit_rows.write.mode("overwrite").parquet(rows)
    pipeline_model(model, prep, name, rows).write().overwrite().save(os.path.join(path, "pipeline"))


def load_pipeline(path: str) -> PipelineModel:
    """The saved best model: raw feature columns → x, score, prediction; tables and streams."""
    return PipelineModel.load(os.path.join(path, "pipeline"))


def load_model(spark: SparkSession, path: str):
    """Return (name, scorer of prepared rows, Prepared) for a saved best model."""
    pipeline = load_pipeline(path)
    return pipeline.stages[0].model_name, scorer(pipeline), pipeline.stages[0].prepared
