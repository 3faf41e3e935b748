"""Training-data queries (C11–C13, M1–M7, M10 folds, M21 split info)."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronus import config as C
from patronus.functions.keyed import sql_keyed_normal
from patronus.functions.numeric import rnd
from patronus.operators import clusters as K
from patronus.operators import prep as P
from patronus.operators import rfm
from patronus.operators.features import FINAL, fit_preps
from patronus.plans.clusters import KM
from patronus.plans.registry import oracle, query
from patronus.plans.sqlbits import R, with_base
from patronus.sources.customer_table import stored_profiles
from patronus.sources.tables import tables

TRAIN_INTERCEPT = 0.0  # see README: the reference intercept leaves too few positives here
ONEHOT_MIN_FREQ = 0.04


def labeled_sql(src: str, intercept: float) -> str:
    """CTEs lab_mm / lab: min-max features and the keyed-noise label over ``src``."""
    feats = C.LABEL_FEATURES
    mm = ", ".join(f"min({f}) AS mn_{f}, max({f}) AS mx_{f}" for f in feats)
    norm = {f: (f"CAST({f} - mn_{f} AS DOUBLE) / CAST(coalesce(nullif(mx_{f} - mn_{f}, 0), 1) AS DOUBLE)")
            for f in feats}
    z = " + ".join(f"({C.LABEL_WEIGHTS[f]!r}::DOUBLE * ({norm[f]}))"
                   for f in ["Recency", "Frequency", "Monetary", "UniqueProducts", "AvgOrderValue"])
    # left-to-right sum, as the Spark expression
    terms = [f"({C.LABEL_WEIGHTS[f]!r}::DOUBLE * ({norm[f]}))"
             for f in ["Recency", "Frequency", "Monetary", "UniqueProducts", "AvgOrderValue"]]
    z = terms[0]
    for t in terms[1:]:
        z = f"({z} + {t})"
    z = f"(({z} + {float(intercept)!r}::DOUBLE) + {sql_keyed_normal('CustomerID', C.SEED, C.LABEL_NOISE_STD)})"
    return f"""
lab_mm AS (SELECT {mm} FROM {src}),
lab AS (SELECT s.*, 1.0 / (1.0 + exp(-{z})) AS churn_prob,
               CAST(1.0 / (1.0 + exp(-{z})) > 0.5 AS INTEGER) AS ChurnBinary
        FROM {src} s CROSS JOIN lab_mm)"""


def split_sql(src: str = "lab") -> str:
    return f"""
cls AS (SELECT ChurnBinary, count(*) AS n_class FROM {src} GROUP BY ChurnBinary),
cls2 AS (SELECT ChurnBinary, n_class, sum(n_class) OVER () AS n_all,
                ceil({C.TEST_FRACTION!r}::DOUBLE * sum(n_class) OVER ()) AS n_test_all FROM cls),
cls3 AS (SELECT *, n_test_all * n_class / n_all AS share, floor(n_test_all * n_class / n_all) AS base_ FROM cls2),
cls4 AS (SELECT *, n_test_all - sum(base_) OVER () AS left_,
                row_number() OVER (ORDER BY share - base_ DESC, ChurnBinary) AS ord FROM cls3),
alloc AS (SELECT ChurnBinary, CAST(base_ + CASE WHEN ord <= left_ THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM cls4),
rk AS (SELECT s.*, row_number() OVER (PARTITION BY ChurnBinary
                   ORDER BY md5(CAST(CustomerID AS VARCHAR) || ':{C.SEED}'), CustomerID) AS rnk FROM {src} s),
spl AS (SELECT rk.* EXCLUDE (rnk), CASE WHEN rnk <= n_test THEN 'test' ELSE 'train' END AS split,
               CASE WHEN rnk <= n_test THEN NULL ELSE CAST((rnk - n_test - 1) % {C.CV_FOLDS} AS INTEGER) END AS fold
        FROM rk JOIN alloc USING (ChurnBinary))"""


# ---- Spark builders ----------------------------------------------------------------

def labeled_profiles(spark, sf, intercept):
    return P.churn_label(stored_profiles(tables(spark, sf)), intercept=intercept)


def training(spark, sf, intercept=TRAIN_INTERCEPT):
    prof = K.with_clusters(stored_profiles(tables(spark, sf)))
    return P.training_frame(prof, intercept=intercept)


def split_only(spark, sf, intercept=TRAIN_INTERCEPT):
    lab = labeled_profiles(spark, sf, intercept).select("CustomerID", "ChurnBinary")
    return P.stratified_split(lab)


# C11
@query("minmax_features")
def q_minmax(spark, sf):
    x = P.minmax(rfm.customer_base(tables(spark, sf)), C.LABEL_FEATURES)
    return x.select("CustomerID", *[rnd(F.col(f"{f}_norm"), 6).alias(f"{f}_norm") for f in C.LABEL_FEATURES])


oracle("minmax_features", with_base(
    "SELECT CustomerID, " + ", ".join(
        R(f"CAST({f} - mn_{f} AS DOUBLE) / CAST(coalesce(nullif(mx_{f} - mn_{f}, 0), 1) AS DOUBLE)", 6)
        + f" AS {f}_norm" for f in C.LABEL_FEATURES)
    + " FROM base CROSS JOIN (SELECT " + ", ".join(f"min({f}) AS mn_{f}, max({f}) AS mx_{f}"
                                                     for f in C.LABEL_FEATURES) + " FROM base)"))


# C12/C13 with the reference intercept
@query("churn_target")
def q_churn_target(spark, sf):
    x = labeled_profiles(spark, sf, C.LABEL_INTERCEPT)
    return x.select("CustomerID", rnd(F.col("churn_prob"), 6).alias("churn_prob"), "ChurnBinary")


oracle("churn_target", with_base(f"SELECT CustomerID, {R('churn_prob', 6)} AS churn_prob, ChurnBinary FROM lab",
                                 labeled_sql("base", C.LABEL_INTERCEPT)))


# M7
@query("stratified_split")
def q_split(spark, sf):
    return split_only(spark, sf).select("CustomerID", "ChurnBinary", "split", "fold")


oracle("stratified_split", with_base("SELECT CustomerID, ChurnBinary, split, fold FROM spl",
                                     labeled_sql("base", TRAIN_INTERCEPT) + "," + split_sql()))


# M10 fold column summary
@query("cv_folds")
def q_cv_folds(spark, sf):
    s = split_only(spark, sf)
    return (s.where(F.col("split") == "train").groupBy("fold")
             .agg(F.count(F.lit(1)).alias("rows"), F.sum("ChurnBinary").cast("long").alias("positives")))


oracle("cv_folds", with_base(
    "SELECT fold, count(*) AS rows, CAST(sum(ChurnBinary) AS BIGINT) AS positives FROM spl "
    "WHERE split = 'train' GROUP BY fold", labeled_sql("base", TRAIN_INTERCEPT) + "," + split_sql()))


# E16/M21
@query("split_info")
def q_split_info(spark, sf):
    s = split_only(spark, sf)
    tr, te = F.col("split") == "train", F.col("split") == "test"
    x = s.agg(F.count(F.lit(1)).alias("total_samples"),
              F.count_if(tr).alias("train_samples"), F.count_if(te).alias("test_samples"),
              F.avg(F.when(tr, F.col("ChurnBinary"))).alias("rt"),
              F.avg(F.when(te, F.col("ChurnBinary"))).alias("re"))
    return x.select("total_samples", "train_samples", "test_samples",
                    rnd(F.col("rt") * 100, 1).alias("churn_rate_train"),
                    rnd(F.col("re") * 100, 1).alias("churn_rate_test"),
                    F.lit(",".join(C.ALL_FEATURES)).alias("features_used"),
                    F.lit(",".join(C.LEAKY_REPORTED)).alias("leaky_features_removed"),
                    ((F.col("rt") < C.SMOTE_LOW) | (F.col("rt") > C.SMOTE_HIGH)).alias("smote_applied"),
                    F.lit(C.CV_FOLDS).alias("cv_folds"))


oracle("split_info", with_base(f"""
SELECT total_samples, train_samples, test_samples, {R('rt * 100', 1)} AS churn_rate_train,
       {R('re * 100', 1)} AS churn_rate_test, '{",".join(C.ALL_FEATURES)}' AS features_used,
       '{",".join(C.LEAKY_REPORTED)}' AS leaky_features_removed,
       (rt < {C.SMOTE_LOW} OR rt > {C.SMOTE_HIGH}) AS smote_applied, {C.CV_FOLDS} AS cv_folds
FROM (SELECT count(*) AS total_samples, count(*) FILTER (WHERE split = 'train') AS train_samples,
             count(*) FILTER (WHERE split = 'test') AS test_samples,
             avg(ChurnBinary) FILTER (WHERE split = 'train') AS rt,
             avg(ChurnBinary) FILTER (WHERE split = 'test') AS re FROM spl)""",
    labeled_sql("base", TRAIN_INTERCEPT) + "," + split_sql()))


# M1 (features incl. the cluster id)
_TRAIN_SQL = KM + "," + labeled_sql("crfm", TRAIN_INTERCEPT) + "," + split_sql()


@query("training_set")
def q_training_set(spark, sf):
    return training(spark, sf)


oracle("training_set", with_base(
    f"SELECT CustomerID, {', '.join(C.ALL_FEATURES)}, ChurnBinary, split, fold FROM spl", _TRAIN_SQL))


# M2
@query("impute_numeric")
def q_impute_numeric(spark, sf):
    tr = training(spark, sf).where(F.col("split") == "train")
    return P.medians(tr, C.NUMERIC_FEATURES)


oracle("impute_numeric", with_base(
    "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in C.NUMERIC_FEATURES)
    + " FROM spl WHERE split = 'train'", _TRAIN_SQL))


# M3
@query("standardize")
def q_standardize(spark, sf):
    x = training(spark, sf)
    st = P.scaler_stats(x.where(F.col("split") == "train"), C.NUMERIC_FEATURES)
    z = P.standardize(x, st, C.NUMERIC_FEATURES)
    return z.select("CustomerID", *[rnd(F.col(c), 6).alias(c) for c in C.NUMERIC_FEATURES])


oracle("standardize", with_base(
    "SELECT CustomerID, " + ", ".join(
        f"CASE WHEN coalesce(sd_{c}, 0) = 0 THEN 0.0 ELSE {R(f'(CAST({c} AS DOUBLE) - mu_{c}) / sd_{c}', 6)} END AS {c}"
        for c in C.NUMERIC_FEATURES)
    + " FROM spl CROSS JOIN (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}"
                                                    for c in C.NUMERIC_FEATURES)
    + " FROM spl WHERE split = 'train')", _TRAIN_SQL))


# M4
@query("impute_mode")
def q_impute_mode(spark, sf):
    tr = split_only_features(spark, sf).where(F.col("split") == "train")
    return P.mode_of(tr, "Country")


def split_only_features(spark, sf):
    """Split rows with Country (no cluster needed for the categorical path)."""
    lab = labeled_profiles(spark, sf, TRAIN_INTERCEPT).select("CustomerID", "Country", "ChurnBinary")
    return P.stratified_split(lab)


_SPLIT_SQL = labeled_sql("base", TRAIN_INTERCEPT) + "," + split_sql()

oracle("impute_mode", with_base("""
SELECT Country AS mode, count(*) AS count FROM spl WHERE split = 'train' AND Country IS NOT NULL
GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 1""", _SPLIT_SQL))


# M5
@query("onehot_country")
def q_onehot(spark, sf):
    x = split_only_features(spark, sf)
    prep = fit_preps(x.where(F.col("split") == "train"), 0, ONEHOT_MIN_FREQ, numeric=[])[FINAL]
    return x.select("CustomerID", F.coalesce("Country", F.lit(prep.mode)).alias("Country"), prep.onehot_column().alias("onehot_column"))


oracle("onehot_country", with_base(f"""
SELECT CustomerID, Country,
       CASE WHEN f.category IS NULL THEN (CASE WHEN hr.has_rare = 1 THEN '{C.RARE_BUCKET}' END)
            WHEN f.dropped THEN NULL
            WHEN f.kept THEN 'Country_' || f.category
            ELSE '{C.RARE_BUCKET}' END AS onehot_column
FROM imp LEFT JOIN fitc f ON f.category = imp.Country CROSS JOIN hr""", _SPLIT_SQL + f""",
md AS (SELECT Country AS mode FROM spl WHERE split = 'train' AND Country IS NOT NULL
       GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 1),
imp AS (SELECT spl.CustomerID, coalesce(spl.Country, md.mode) AS Country, spl.split FROM spl CROSS JOIN md),
cnt AS (SELECT Country AS category, count(*) AS cnt FROM imp WHERE split = 'train' AND Country IS NOT NULL
        GROUP BY Country),
fitk AS (SELECT category, cnt >= {ONEHOT_MIN_FREQ!r}::DOUBLE * sum(cnt) OVER () AS kept FROM cnt),
fitc AS (SELECT category, kept,
                kept AND category = (SELECT min(category) FROM fitk WHERE kept) AS dropped FROM fitk),
hr AS (SELECT CAST(max(CASE WHEN NOT kept THEN 1 ELSE 0 END) AS INTEGER) AS has_rare FROM fitc)"""))
