"""Evaluation queries (M11–M19, W7) over rule predictors.

The reference's rule path scores churn as ChurnScore / 100 and flags
Recency > 90 days; a second rule uses the RFM score.  They need no fit, so
every metric built on them has an exact SQL oracle.  Trained models
(``plans.models``) feed the very same metric functions.

predictions: one row per (model, split, fold, customer); ``fold`` is the CV
fold for 'cv_test' / 'cv_train' rows and -1 for 'test' / 'train' rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronus import config as C
from patronus.operators import compare as CMP
from patronus.operators import metrics as M
from patronus.operators import prep as P
from patronus.operators.training import evaluation
from patronus.plans.registry import oracle, query
from patronus.functions.text import sql_fill
from patronus.plans.sqlbits import R, with_base
from patronus.plans.training import TRAIN_INTERCEPT, labeled_sql, split_sql
from patronus.session import scratch_path
from patronus.sources.customer_table import stored_profiles
from patronus.sources.files import read_explanation_json
from patronus.sources.sinks import write_json_document
from patronus.sources.tables import tables



def rules():
    """name → (score, prediction, listing order); built when a session exists."""
    return {
        "Recency Rule": (F.col("ChurnScore") / 100, F.col("ChurnRisk") == "High", 0),
        "RFM Rule": ((F.lit(12) - F.col("RFM_Score")) / F.lit(9.0), F.col("RFM_Score") <= 5, 1),
    }


RULES_SQL = {
    "Recency Rule": ("ChurnScore / 100", "ChurnRisk = 'High'", 0),
    "RFM Rule": ("(12 - RFM_Score) / 9.0", "RFM_Score <= 5", 1),
}


def expand_splits(df: DataFrame, folds: int = C.CV_FOLDS) -> DataFrame:
    """Rows of a split frame → evaluation rows: test rows once ('test'),
    train rows as 'train', as 'cv_test' of their fold and 'cv_train' of
    every other fold."""
    tag = lambda s, f: F.struct(F.lit(s).alias("split"), f.cast("int").alias("fold"))
    others = F.filter(F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda g: tag("cv_train", g)),
                      lambda s: s["fold"] != F.col("fold"))
    tags = F.when(F.col("split") == "test", F.array(tag("test", F.lit(-1)))).otherwise(
        F.concat(F.array(tag("train", F.lit(-1)), tag("cv_test", F.col("fold"))), others))
    return df.withColumn("_t", F.explode(tags)).drop("split", "fold").select("*", "_t.split", "_t.fold").drop("_t")


def rule_predictions(spark, sf) -> DataFrame:
    prof = stored_profiles(tables(spark, sf))
    lab = P.stratified_split(P.churn_label(prof, intercept=TRAIN_INTERCEPT))
    models = F.array(*[F.struct(F.lit(n).alias("model"), s.cast("double").alias("score"),
                                p.cast("int").alias("prediction"))
                       for n, (s, p, _) in rules().items()])
    x = lab.select("CustomerID", F.col("ChurnBinary").alias("label"), "split", "fold",
                   F.explode(models).alias("m")).select("*", "m.*").drop("m")
    # the predictions table: every metric reads it, so it is written once
    return (expand_splits(x).select("model", "split", "fold", "CustomerID", "label", "prediction", "score")
            .checkpoint(eager=True))


def rule_metrics(spark, sf) -> DataFrame:
    order = F.create_map(*[x for n, (_, _, o) in rules().items() for x in (F.lit(n), F.lit(o))])
    return M.model_metrics(rule_predictions(spark, sf)).withColumn("order", order[F.col("model")])


# ---- SQL -------------------------------------------------------------------------------

_PRED_SQL = labeled_sql("rfm", TRAIN_INTERCEPT) + "," + split_sql() + ",\n" + """
rp AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS model, CustomerID, ChurnBinary AS label, split, fold, CAST({s} AS DOUBLE) AS score, "
    f"CAST({p} AS INTEGER) AS prediction FROM spl" for n, (s, p, _) in RULES_SQL.items()) + """),
preds AS (
  SELECT model, 'test' AS split, -1 AS fold, CustomerID, label, prediction, score FROM rp WHERE split = 'test'
  UNION ALL SELECT model, 'train', -1, CustomerID, label, prediction, score FROM rp WHERE split = 'train'
  UNION ALL SELECT model, 'cv_test', fold, CustomerID, label, prediction, score FROM rp WHERE split = 'train'
  UNION ALL SELECT model, 'cv_train', g, CustomerID, label, prediction, score
            FROM rp CROSS JOIN range(0, 5) t(g) WHERE split = 'train' AND g <> fold),
cm AS (SELECT model, split, fold,
              count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
       FROM preds GROUP BY model, split, fold),
rt AS (SELECT *, CASE WHEN tp+tn+fp+fn <> 0 THEN CAST(tp+tn AS DOUBLE) / CAST(tp+tn+fp+fn AS DOUBLE) ELSE 0.0 END AS acc,
              CASE WHEN tp+fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp+fp AS DOUBLE) ELSE 0.0 END AS prec,
              CASE WHEN tp+fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp+fn AS DOUBLE) ELSE 0.0 END AS rec,
              CASE WHEN 2*tp+fp+fn <> 0 THEN CAST(2*tp AS DOUBLE) / CAST(2*tp+fp+fn AS DOUBLE) ELSE 0.0 END AS f1
       FROM cm),
ps AS (SELECT model, split, fold, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
       FROM preds GROUP BY model, split, fold, score),
sp AS (SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg, count(*) OVER w AS cdist,
              sum(pos) OVER g AS P, sum(neg) OVER g AS N, count(*) OVER g AS D
       FROM ps WINDOW w AS (PARTITION BY model, split, fold ORDER BY score ROWS UNBOUNDED PRECEDING),
                      g AS (PARTITION BY model, split, fold)),
auc AS (SELECT model, split, fold,
               CASE WHEN 2*P*N <> 0 THEN CAST(sum(2 * (cneg - neg) * pos + pos * neg) AS DOUBLE) / CAST(2*P*N AS DOUBLE)
                    ELSE 0.0 END AS auc
        FROM sp GROUP BY model, split, fold, P, N),
mm AS (
  SELECT model,
         max(acc) FILTER (WHERE split = 'test') AS acc_, max(prec) FILTER (WHERE split = 'test') AS prec_,
         max(rec) FILTER (WHERE split = 'test') AS rec_, max(f1) FILTER (WHERE split = 'test') AS f1_,
         max(auc) FILTER (WHERE split = 'test') AS auc_, max(acc) FILTER (WHERE split = 'train') AS tr_acc,
         CAST(sum(CAST(acc AS DECIMAL(38,18))) FILTER (WHERE split = 'cv_test') / count(acc) FILTER (WHERE split = 'cv_test') AS DOUBLE) AS cv_acc,
         CAST(sum(CAST(f1 AS DECIMAL(38,18))) FILTER (WHERE split = 'cv_test') / count(f1) FILTER (WHERE split = 'cv_test') AS DOUBLE) AS cv_f1_,
         CAST(sum(CAST(auc AS DECIMAL(38,18))) FILTER (WHERE split = 'cv_test') / count(auc) FILTER (WHERE split = 'cv_test') AS DOUBLE) AS cv_auc_,
         CAST(sum(CAST(acc AS DECIMAL(38,18))) FILTER (WHERE split = 'cv_train') / count(acc) FILTER (WHERE split = 'cv_train') AS DOUBLE) AS cv_tr_acc
  FROM rt LEFT JOIN auc USING (model, split, fold) GROUP BY model),
met AS (
  SELECT model, """ + R("acc_ * 100", 2) + " AS accuracy, " + R("prec_ * 100", 2) + " AS precision, " + \
    R("rec_ * 100", 2) + " AS recall, " + R("f1_ * 100", 2) + " AS f1, " + R("auc_ * 100", 2) + " AS auc, " + \
    R("tr_acc * 100", 2) + " AS train_accuracy, " + R("cv_acc * 100", 2) + " AS cv_accuracy, " + \
    R("cv_f1_ * 100", 2) + " AS cv_f1, " + R("cv_auc_ * 100", 2) + " AS cv_auc, " + \
    R("cv_tr_acc * 100", 2) + " AS cv_train_accuracy, " + R("(cv_tr_acc - cv_acc) * 100", 2) + \
    " AS cv_accuracy_gap, " + R("(tr_acc - acc_) * 100", 2) + " AS accuracy_gap, " + \
    R("greatest((tr_acc - acc_) * 100, (cv_tr_acc - cv_acc) * 100)", 2) + " AS generalization_gap, " + \
    "greatest((tr_acc - acc_) * 100, (cv_tr_acc - cv_acc) * 100) > 8.0 AS overfitting, " + \
    "CASE model " + " ".join(f"WHEN '{n}' THEN {o}" for n, (_, _, o) in RULES_SQL.items()) + \
    " END AS \"order\" FROM mm)"


def _q(body: str) -> str:
    return with_base(body, _PRED_SQL)


@query("classification_metrics")
def q_class_metrics(spark, sf):
    return M.classification_metrics(rule_predictions(spark, sf))


oracle("classification_metrics", _q(
    f"SELECT model, split, fold, {R('acc * 100', 2)} AS accuracy, {R('prec * 100', 2)} AS precision, "
    f"{R('rec * 100', 2)} AS recall, {R('f1 * 100', 2)} AS f1 FROM rt"))


@query("confusion_matrix")
def q_confusion(spark, sf):
    return M.confusion_matrix(rule_predictions(spark, sf))


oracle("confusion_matrix", _q(
    "SELECT model, split, fold, tn, fp, fn, tp, " + ", ".join(
        R(f"CASE WHEN tn+fp+fn+tp <> 0 THEN CAST({c} AS DOUBLE) / CAST(tn+fp+fn+tp AS DOUBLE) ELSE 0.0 END * 100", 1)
        + f" AS {c}_pct" for c in ("tn", "fp", "fn", "tp")) + " FROM cm"))


@query("classification_report")
def q_class_report(spark, sf):
    return M.classification_report(rule_predictions(spark, sf).where(F.col("split") == "test"))


def _d(num, den):
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END"


_P0, _R0, _F0 = _d("tn", "tn+fn"), _d("tn", "tn+fp"), _d("2*tn", "2*tn+fn+fp")
_P1, _R1, _F1 = _d("tp", "tp+fp"), _d("tp", "tp+fn"), _d("2*tp", "2*tp+fp+fn")
oracle("classification_report", _q(f"""
SELECT model, split, fold, '0' AS row, {R(_P0, 4)} AS precision, {R(_R0, 4)} AS recall, {R(_F0, 4)} AS f1, tn + fp AS support FROM cm WHERE split = 'test'
UNION ALL SELECT model, split, fold, '1', {R(_P1, 4)}, {R(_R1, 4)}, {R(_F1, 4)}, tp + fn FROM cm WHERE split = 'test'
UNION ALL SELECT model, split, fold, 'accuracy', NULL, NULL, {R(_d('tp+tn', 'tp+tn+fp+fn'), 4)}, tp+tn+fp+fn FROM cm WHERE split = 'test'
UNION ALL SELECT model, split, fold, 'macro avg', {R(f'({_P0} + {_P1}) / 2', 4)}, {R(f'({_R0} + {_R1}) / 2', 4)},
       {R(f'({_F0} + {_F1}) / 2', 4)}, tp+tn+fp+fn FROM cm WHERE split = 'test'
UNION ALL SELECT model, split, fold, 'weighted avg',
       {R(f'({_P0} * CAST(tn+fp AS DOUBLE) + {_P1} * CAST(tp+fn AS DOUBLE)) / (tp+tn+fp+fn)', 4)},
       {R(f'({_R0} * CAST(tn+fp AS DOUBLE) + {_R1} * CAST(tp+fn AS DOUBLE)) / (tp+tn+fp+fn)', 4)},
       {R(f'({_F0} * CAST(tn+fp AS DOUBLE) + {_F1} * CAST(tp+fn AS DOUBLE)) / (tp+tn+fp+fn)', 4)},
       tp+tn+fp+fn FROM cm WHERE split = 'test'"""))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return M.roc_auc(rule_predictions(spark, sf))


oracle("roc_auc", _q(f"SELECT model, split, fold, {R('auc', 6)} AS auc, {R('auc * 100', 2)} AS auc_pct FROM auc"))


@query("average_precision")
def q_ap(spark, sf):
    return M.average_precision(rule_predictions(spark, sf))


oracle("average_precision", _q(f"""
SELECT model, split, fold, {R('CAST(sum(CAST(CAST(pos * (P - cpos + pos) AS DOUBLE) / CAST(P * ((P - cpos + pos) + (N - cneg + neg)) AS DOUBLE) AS DECIMAL(38,18))) AS DOUBLE)', 6)}
       AS average_precision FROM sp GROUP BY model, split, fold"""))


@query("roc_points")
def q_roc_points(spark, sf):
    return M.roc_points(rule_predictions(spark, sf))


oracle("roc_points", _q(f"""
SELECT model, split, fold, CAST(kidx AS INTEGER) AS idx,
       {R('CASE WHEN N <> 0 THEN CAST(fps AS DOUBLE) / CAST(N AS DOUBLE) ELSE 0.0 END', 4)} AS fpr,
       {R('CASE WHEN P <> 0 THEN CAST(tps AS DOUBLE) / CAST(P AS DOUBLE) ELSE 0.0 END', 4)} AS tpr
FROM km WHERE kidx % greatest(1, m // 100) = 0""", ) .replace("\nSELECT model, split, fold, CAST(kidx", """,
pts AS (SELECT model, split, fold, D - cdist AS j, D, P, N, P - cpos + pos AS tps, N - cneg + neg AS fps FROM sp),
nb AS (SELECT *, lag(tps) OVER o AS tps_p, lag(fps) OVER o AS fps_p, lead(tps) OVER o AS tps_n, lead(fps) OVER o AS fps_n
       FROM pts WINDOW o AS (PARTITION BY model, split, fold ORDER BY j)),
kept AS (SELECT * FROM nb WHERE j = 0 OR j = D - 1 OR fps_n - 2 * fps + fps_p <> 0 OR tps_n - 2 * tps + tps_p <> 0),
kp AS (SELECT model, split, fold, row_number() OVER (PARTITION BY model, split, fold ORDER BY j) AS kidx, P, N, tps, fps FROM kept
       UNION ALL SELECT DISTINCT model, split, fold, 0, P, N, 0, 0 FROM kept),
km AS (SELECT *, count(*) OVER (PARTITION BY model, split, fold) AS m FROM kp)
SELECT model, split, fold, CAST(kidx""", 1))


@query("model_metrics_rule")
def q_model_metrics(spark, sf):
    return rule_metrics(spark, sf).drop("order")


oracle("model_metrics_rule", _q("SELECT * EXCLUDE (\"order\") FROM met"))


@query("overfit_flags")
def q_overfit(spark, sf):
    return M.overfit_flags(rule_metrics(spark, sf))


oracle("overfit_flags", _q("""
SELECT model, accuracy_gap, cv_accuracy_gap, generalization_gap,
       coalesce(generalization_gap, accuracy_gap, greatest(0.0, coalesce(train_accuracy, 0.0) - coalesce(accuracy, 0.0))) AS gap_used,
       coalesce(generalization_gap, accuracy_gap, greatest(0.0, coalesce(train_accuracy, 0.0) - coalesce(accuracy, 0.0))) > 8.0 AS overfit
FROM met"""))


@query("model_leaderboard")
def q_leaderboard(spark, sf):
    return CMP.leaderboard(rule_metrics(spark, sf))


oracle("model_leaderboard", _q("""
SELECT row_number() OVER (ORDER BY f1 DESC, "order") AS rank, model, accuracy, precision, recall, f1, auc,
       min(accuracy) OVER () AS accuracy_min, max(accuracy) OVER () AS accuracy_max FROM met"""))


def _fmt_sql(x: str, d: int) -> str:
    return f"format('{{:.{d}f}}', {R(x, d)})"


_EXPL_VALUES = {
    "best_model": "best_model", "f1_1": _fmt_sql("best_model_f1", 1),
    "reasons": f"CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') ELSE '{CMP.DEFAULT_REASON}' END",
    "threshold": "'8'", "overfit_models": "overfit_models", "prefer": "coalesce(first_clean, best_model)",
    "recall_0": _fmt_sql("b_rec", 0), "recall_1": _fmt_sql("b_rec", 1), "precision_0": _fmt_sql("b_prec", 0),
    "false_alarms_0": _fmt_sql("100 - b_prec", 0), "auc_1": _fmt_sql("best_model_auc", 1),
    "acc_min_1": _fmt_sql("accuracy_min", 1), "acc_max_1": _fmt_sql("accuracy_max", 1)}
_EXPL_SQL = f"""
SELECT best_model, best_model_f1, best_model_auc, highest_auc_model, highest_auc,
       overfit_models, clean_models, accuracy_min, accuracy_max,
       {sql_fill(CMP.WHY_TEMPLATE, _EXPL_VALUES)} AS why_best_performed,
       CASE WHEN overfit_models <> '' THEN {sql_fill(CMP.OVERFIT_TEMPLATE, _EXPL_VALUES)}
            ELSE {sql_fill(CMP.NO_OVERFIT_TEMPLATE, _EXPL_VALUES)} END AS overfitting_analysis,
       {sql_fill(CMP.BUSINESS_TEMPLATE, _EXPL_VALUES)} AS business_interpretation,
       {sql_fill(CMP.RANGE_TEMPLATE, _EXPL_VALUES)} AS accuracy_range_note
FROM (
  SELECT b.model AS best_model, b.f1 AS best_model_f1, b.auc AS best_model_auc, b.recall AS b_rec, b.precision AS b_prec,
         h.model AS highest_auc_model, h.auc AS highest_auc,
         (SELECT coalesce(string_agg(model, ', ' ORDER BY "order"), '') FROM met WHERE coalesce(generalization_gap, accuracy_gap) > 8.0) AS overfit_models,
         (SELECT coalesce(string_agg(model, ', ' ORDER BY "order"), '') FROM met WHERE coalesce(generalization_gap, accuracy_gap) <= 8.0) AS clean_models,
         (SELECT model FROM met WHERE coalesce(generalization_gap, accuracy_gap) <= 8.0 ORDER BY "order" LIMIT 1) AS first_clean,
         (SELECT min(accuracy) FROM met) AS accuracy_min, (SELECT max(accuracy) FROM met) AS accuracy_max,
         list_filter([
           CASE WHEN contains(b.model, 'Forest') OR contains(b.model, 'Boosting') OR contains(b.model, 'XGB') THEN '{CMP.ENSEMBLE_REASON}' END,
           CASE WHEN contains(b.model, 'Regression') THEN '{CMP.LINEAR_REASON}' END,
           CASE WHEN b.cv_accuracy > 0 AND abs(b.accuracy - b.cv_accuracy) < 3 THEN '{CMP.CV_REASON}' END], lambda x: x IS NOT NULL) AS parts
  FROM (SELECT * FROM met ORDER BY f1 DESC, "order" LIMIT 1) b
  CROSS JOIN (SELECT * FROM met ORDER BY auc DESC, "order" LIMIT 1) h)"""


@query("model_explanation")
def q_explanation(spark, sf):
    return CMP.explanation(rule_metrics(spark, sf))


oracle("model_explanation", _q(_EXPL_SQL))


# The nested document written by Spark and read back with its declared schema
@query("explanation_document")
def q_explanation_document(spark, sf):
    path = scratch_path(spark, f"explanation-{uuid.uuid4().hex}")
    write_json_document(CMP.explanation_document(rule_metrics(spark, sf)), path)
    return CMP.flat_explanation(read_explanation_json(spark, path))


oracle("explanation_document", _q(_EXPL_SQL))


# M22 on the two rule predictors
@query("evaluation_summary")
def q_evaluation_summary(spark, sf):
    return evaluation(rule_predictions(spark, sf))


oracle("evaluation_summary", _q(f"""
SELECT model, split, fold, tn, fp, fn, tp, {R('acc * 100', 2)} AS accuracy, {R('prec * 100', 2)} AS precision,
       {R('rec * 100', 2)} AS recall, {R('f1 * 100', 2)} AS f1, {R('auc', 6)} AS auc, average_precision
FROM rt LEFT JOIN auc USING (model, split, fold) LEFT JOIN (
  SELECT model, split, fold, {R('CAST(sum(CAST(CAST(pos * (P - cpos + pos) AS DOUBLE) / CAST(P * ((P - cpos + pos) + (N - cneg + neg)) AS DOUBLE) AS DECIMAL(38,18))) AS DOUBLE)', 6)}
         AS average_precision FROM sp GROUP BY model, split, fold) USING (model, split, fold)"""))
