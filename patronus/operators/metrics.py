"""Evaluation tables over a long predictions frame.

predictions: (model string, split string, fold int, CustomerID long,
              label int, prediction int, score double)

Every metric is one grouped aggregation over (model, split, fold), so all
models, splits and folds are evaluated in the same job.  Curve metrics
(AUC, ROC, AP) first pre-aggregate per distinct score, then take running
counts two-level (``prefix.two_level``), so no single task holds a whole
model's scores.  Counts stay integers until one final division, which
makes the numbers independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronus.functions.numeric import rnd
from patronus.operators.prefix import two_level
from patronus.operators.quantiles import search

GROUP = ["model", "split", "fold"]
SCORE_BUCKETS = 256  # ordered slices of the distinct scores, cut at their quantiles


def _whole(c: Column) -> Column:
    """A count as DECIMAL: products of counts exceed 64 bits on large tables."""
    return c.cast("decimal(19,0)")


def _ratio(num: Column, den: Column) -> Column:
    """num / den with zero_division = 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion_counts(preds: DataFrame, group: list[str] = GROUP) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return preds.groupBy(*group).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def rates(cm: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 as fractions (f1 = 2tp / (2tp+fp+fn))."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (cm.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
              .withColumn("precision", _ratio(tp, tp + fp))
              .withColumn("recall", _ratio(tp, tp + fn))
              .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)))


def classification_metrics(preds: DataFrame) -> DataFrame:
    """Percent, 2 dp, per (model, split, fold)."""
    r = rates(confusion_counts(preds))
    return r.select(*GROUP, *[rnd(F.col(m) * 100, 2).alias(m)
                              for m in ("accuracy", "precision", "recall", "f1")])


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """Tn, fp, fn, tp and each as a share (%) of the rows, 1 dp."""
    cm = confusion_counts(preds)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return cm.select(*GROUP, "tn", "fp", "fn", "tp",
                     *[rnd(_ratio(F.col(c), n) * 100, 1).alias(f"{c}_pct") for c in ("tn", "fp", "fn", "tp")])


def classification_report(preds: DataFrame) -> DataFrame:
    """Per class precision / recall / f1 / support, plus accuracy,
    macro and weighted averages (fractions, 4 dp)."""
    cm = confusion_counts(preds)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    c1 = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    c0 = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp), tn + fp)
    acc = _ratio(tp + tn, n)

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("row"), rnd(p, 4).alias("precision"), rnd(r, 4).alias("recall"),
                        rnd(f, 4).alias("f1"), s.cast("long").alias("support"))
    w0, w1 = c0[3].cast("double"), c1[3].cast("double")
    rows = F.array(
        row("0", *c0), row("1", *c1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (c0[0] + c1[0]) / 2, (c0[1] + c1[1]) / 2, (c0[2] + c1[2]) / 2, n),
        row("weighted avg", (c0[0] * w0 + c1[0] * w1) / n, (c0[1] * w0 + c1[1] * w1) / n,
            (c0[2] * w0 + c1[2] * w1) / n, n))
    return cm.select(*GROUP, F.explode(rows).alias("r")).select(*GROUP, "r.*")


def score_points(preds: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Per distinct score: pos, neg, and running counts in ascending score
    order (inclusive), plus the group's totals P, N and distinct count D."""
    # read three times (bucket totals, group totals, windows): written once
    ps = preds.groupBy(*group, "score").agg(F.sum("label").cast("long").alias("pos"),
                                           F.sum(1 - F.col("label")).cast("long").alias("neg")) \
              .checkpoint(eager=True)
    # boundaries from the scores themselves, so crowded scores spread as well (≤ 255 doubles)
    cuts = ps.agg(F.percentile_approx("score", [i / SCORE_BUCKETS for i in range(1, SCORE_BUCKETS)])).first()[0]
    cum = two_level(ps, group, search(F.col("score"), sorted({float(x) for x in cuts or []})), [F.col("score")],
                    {"cpos": F.col("pos"), "cneg": F.col("neg"), "cdist": F.lit(1).cast("long")})
    tot = ps.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                 F.count(F.lit(1)).alias("D"))
    # one row per (model, split, fold): small.  The result feeds several
    # self-joins (ROC neighbours), so its lineage is cut here.
    return cum.join(F.broadcast(tot), group).checkpoint(eager=True)


def roc_auc(preds: DataFrame) -> DataFrame:
    """Mann–Whitney AUC with tie-averaged ranks, per group."""
    sp = score_points(preds)
    below = F.col("cneg") - F.col("neg")           # negatives with a lower score
    a = sp.groupBy(*GROUP, "P", "N").agg(
        F.sum(_whole(F.col("pos")) * _whole(2 * below + F.col("neg"))).alias("twice_u"))
    auc = _ratio(F.col("twice_u"), 2 * _whole(F.col("P")) * _whole(F.col("N")))
    return a.select(*GROUP, rnd(auc, 6).alias("auc"), rnd(auc * 100, 2).alias("auc_pct"))


def average_precision(preds: DataFrame) -> DataFrame:
    """Σ over thresholds (desc) of ΔRecall · Precision."""
    sp = score_points(preds)
    tps = F.col("P") - F.col("cpos") + F.col("pos")   # positives with score >= s
    fps = F.col("N") - F.col("cneg") + F.col("neg")
    term = (_whole(F.col("pos")) * _whole(tps)).cast("double") / (_whole(F.col("P")) * _whole(tps + fps)).cast("double")
    ap = sp.groupBy(*GROUP).agg(F.sum(term.cast("decimal(38,18)")).cast("double").alias("ap"))
    return ap.select(*GROUP, rnd(F.col("ap"), 6).alias("average_precision"))


def roc_points(preds: DataFrame, max_points: int = 100, keep_last: bool = False) -> DataFrame:
    """ROC curve per group — distinct thresholds (desc), collinear
    inner points dropped, (0, 0) prepended, every max(1, n // 100)-th point
    kept (``keep_last`` adds the final point), 4 dp."""
    sp = score_points(preds)
    j = F.col("D") - F.col("cdist")                    # 0-based position, descending
    pts = sp.select(*GROUP, j.alias("j"), "D", "P", "N",
                    (F.col("P") - F.col("cpos") + F.col("pos")).alias("tps"),
                    (F.col("N") - F.col("cneg") + F.col("neg")).alias("fps"))
    prev = pts.select(*GROUP, (F.col("j") + 1).alias("j"), F.col("tps").alias("tps_p"), F.col("fps").alias("fps_p"))
    nxt = pts.select(*GROUP, (F.col("j") - 1).alias("j"), F.col("tps").alias("tps_n"), F.col("fps").alias("fps_n"))
    x = pts.join(prev, [*GROUP, "j"], "left").join(nxt, [*GROUP, "j"], "left")
    keep = ((F.col("j") == 0) | (F.col("j") == F.col("D") - 1)
            | (F.col("fps_n") - 2 * F.col("fps") + F.col("fps_p") != 0)
            | (F.col("tps_n") - 2 * F.col("tps") + F.col("tps_p") != 0))
    kept = x.where(keep).select(*GROUP, "j", "D", "P", "N", "tps", "fps")
    # position among kept points, two-level over j, which runs from 0 to D - 1
    kb = F.floor(F.col("j") * SCORE_BUCKETS / F.greatest(F.col("D"), F.lit(1)))
    kept = two_level(kept, GROUP, kb, [F.col("j")], {"kidx": F.lit(1).cast("long")}).checkpoint(eager=True)
    origin = kept.where(F.col("kidx") == 1).select(*GROUP, F.lit(0).cast("long").alias("kidx"), "P", "N",
                                                   F.lit(0).cast("long").alias("tps"),
                                                   F.lit(0).cast("long").alias("fps"))
    allp = kept.select(*GROUP, "kidx", "P", "N", "tps", "fps").unionByName(origin)
    cnt = allp.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("m"))
    allp = allp.join(F.broadcast(cnt), GROUP)
    step = F.greatest(F.lit(1), F.floor(F.col("m") / max_points))
    sel = (F.col("kidx") % step == 0)
    if keep_last:
        sel = sel | (F.col("kidx") == F.col("m") - 1)
    return allp.where(sel).select(*GROUP, F.col("kidx").cast("int").alias("idx"),
                                  rnd(_ratio(F.col("fps"), F.col("N")), 4).alias("fpr"),
                                  rnd(_ratio(F.col("tps"), F.col("P")), 4).alias("tpr"))


def _mean(c: Column) -> Column:
    return (F.sum(c.cast("decimal(38,18)")) / F.count(c)).cast("double")


def model_metrics(preds: DataFrame, gap_threshold: float = 8.0) -> DataFrame:
    """The per-model results record.

    Splits: 'test' and 'train' (fold null), 'cv_test' / 'cv_train' per fold."""
    r = rates(confusion_counts(preds)).join(roc_auc(preds).select(*GROUP, "auc"), GROUP, "left")
    sp = F.col("split")
    m = r.groupBy("model").agg(
        F.max(F.when(sp == "test", F.col("accuracy"))).alias("acc"),
        F.max(F.when(sp == "test", F.col("precision"))).alias("prec"),
        F.max(F.when(sp == "test", F.col("recall"))).alias("rec"),
        F.max(F.when(sp == "test", F.col("f1"))).alias("f1_"),
        F.max(F.when(sp == "test", F.col("auc"))).alias("auc_"),
        F.max(F.when(sp == "train", F.col("accuracy"))).alias("tr_acc"),
        _mean(F.when(sp == "cv_test", F.col("accuracy"))).alias("cv_acc"),
        _mean(F.when(sp == "cv_test", F.col("f1"))).alias("cv_f1_"),
        _mean(F.when(sp == "cv_test", F.col("auc"))).alias("cv_auc_"),
        _mean(F.when(sp == "cv_train", F.col("accuracy"))).alias("cv_tr_acc"))
    acc_gap = (F.col("tr_acc") - F.col("acc")) * 100
    cv_gap = F.col("cv_tr_acc") - F.col("cv_acc")
    gen = F.greatest(acc_gap, cv_gap * 100)
    return m.select(
        "model",
        rnd(F.col("acc") * 100, 2).alias("accuracy"), rnd(F.col("prec") * 100, 2).alias("precision"),
        rnd(F.col("rec") * 100, 2).alias("recall"), rnd(F.col("f1_") * 100, 2).alias("f1"),
        rnd(F.col("auc_") * 100, 2).alias("auc"), rnd(F.col("tr_acc") * 100, 2).alias("train_accuracy"),
        rnd(F.col("cv_acc") * 100, 2).alias("cv_accuracy"), rnd(F.col("cv_f1_") * 100, 2).alias("cv_f1"),
        rnd(F.col("cv_auc_") * 100, 2).alias("cv_auc"),
        rnd(F.col("cv_tr_acc") * 100, 2).alias("cv_train_accuracy"),
        rnd(cv_gap * 100, 2).alias("cv_accuracy_gap"), rnd(acc_gap, 2).alias("accuracy_gap"),
        rnd(gen, 2).alias("generalization_gap"), (gen > gap_threshold).alias("overfitting"))


def gap_used(metrics: DataFrame) -> Column:
    """generalization_gap, else accuracy_gap, else max(0, train - test)."""
    cols = set(metrics.columns)
    chain = [F.col(c) for c in ("generalization_gap", "accuracy_gap") if c in cols]
    fallback = F.greatest(F.lit(0.0), F.coalesce(F.col("train_accuracy"), F.lit(0.0))
                          - F.coalesce(F.col("accuracy"), F.lit(0.0))) if "train_accuracy" in cols else F.lit(0.0)
    return F.coalesce(*chain, fallback)


def overfit_flags(metrics: DataFrame, threshold: float = 8.0) -> DataFrame:
    g = gap_used(metrics)
    return metrics.select("model", "accuracy_gap", "cv_accuracy_gap", "generalization_gap",
                          g.alias("gap_used"), (g > threshold).alias("overfit"))
