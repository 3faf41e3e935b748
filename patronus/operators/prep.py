"""Training data: label, split, folds and the feature transforms
(C6, C7, C11–C13, M1–M7).

* The label is a keyed-noise logistic rule over min-max scaled features
  (scaled over the whole table, as the reference does before splitting).
* Split and folds come from a keyed hash order inside each class, so
  train/test and fold membership are the same on every run and in the
  evaluation job; ranks are computed two-level (``prefix.rank_within``).
* Fitted statistics (medians, mean/σ, mode, kept categories) are small
  one-row or per-category frames computed on the fit rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronus import config as C
from patronus.functions.keyed import keyed_hex, keyed_normal
from patronus.operators.prefix import rank_within
from patronus.operators.quantiles import quantile_row


# --- C7 ----------------------------------------------------------------------------

class LeakageError(ValueError):
    pass


def check_no_leakage(columns: list[str]) -> None:
    """Fail when any leaky column is among the features (schema only)."""
    leaky = [c for c in C.LEAKY_COLUMNS if c in columns]
    if leaky:
        raise LeakageError(f"Leaky columns still present: {leaky}")


# --- C11 ---------------------------------------------------------------------------

def minmax(df: DataFrame, cols: list[str], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0.  The 1-row
    min/max frame is broadcast."""
    mm = df.agg(*[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(mm))
    for c in cols:
        rng = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        x = x.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"_min_{c}")).cast("double")
                         / F.coalesce(F.when(rng != 0, rng), F.lit(1)).cast("double"))
    return x.drop(*mm.columns)


# --- C12, C13 ------------------------------------------------------------------------

def churn_label(df: DataFrame, intercept: float = C.LABEL_INTERCEPT,
                noise_std: float = C.LABEL_NOISE_STD, seed: int = C.SEED,
                key: str = "CustomerID") -> DataFrame:
    """Add churn_prob and ChurnBinary (prob > 0.5)."""
    x = minmax(df, C.LABEL_FEATURES)
    z = None
    for f in ["Recency", "Frequency", "Monetary", "UniqueProducts", "AvgOrderValue"]:
        term = F.lit(C.LABEL_WEIGHTS[f]) * F.col(f"{f}_norm")
        z = term if z is None else z + term
    z = z + F.lit(float(intercept)) + keyed_normal(F.col(key), seed, noise_std)
    x = x.withColumn("churn_prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    x = x.withColumn("ChurnBinary", (F.col("churn_prob") > 0.5).cast("int"))
    return x.drop(*[f"{f}_norm" for f in C.LABEL_FEATURES])


# --- M7, M10 -----------------------------------------------------------------------------

def class_allocation(df: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """Per class: n_class and the number of test rows.

    n_test = ceil(fraction · n); each class gets floor(n_test · n_c / n) and
    the remaining rows go to the largest fractional parts (ties: smaller
    label) — stratified allocation.  ≤ number-of-classes rows."""
    cc = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()
    n = F.sum("n_class").over(w)
    n_test = F.ceil(F.lit(test_fraction) * n)
    share = n_test * F.col("n_class") / n
    cc = cc.withColumn("_share", share).withColumn("_base", F.floor("_share")) \
           .withColumn("_left", n_test - F.sum("_base").over(w)) \
           .withColumn("_order", F.row_number().over(
               Window.orderBy((F.col("_share") - F.col("_base")).desc(), F.col(label))))
    return cc.select(label, "n_class",
                     (F.col("_base") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0))
                     .cast("long").alias("n_test"))


def stratified_split(df: DataFrame, label: str = "ChurnBinary", key: str = "CustomerID",
                     test_fraction: float = C.TEST_FRACTION, folds: int = C.CV_FOLDS,
                     seed: int = C.SEED) -> DataFrame:
    """Add split ('train'/'test') and fold (0..folds-1 for train rows).

    Inside each class, rows are ordered by md5(key:seed) then key; the first
    n_test are test rows, the rest are dealt round-robin into folds."""
    alloc = class_allocation(df, label, test_fraction)
    ranked = rank_within(df.withColumn("_h", keyed_hex(F.col(key), seed)), [label],
                         F.col("_h"), F.col(key), name="_rank")
    # ≤ number-of-classes rows
    x = ranked.join(F.broadcast(alloc.select(label, "n_test")), label)
    is_test = F.col("_rank") <= F.col("n_test")
    # materialised: fit statistics, folds and evaluations all read the split
    return (x.withColumn("split", F.when(is_test, "test").otherwise("train"))
             .withColumn("fold", F.when(is_test, F.lit(None))
                         .otherwise((F.col("_rank") - F.col("n_test") - 1) % folds).cast("int"))
             .drop("_h", "_rank", "n_test")
             .checkpoint(eager=True))


# --- M1 ------------------------------------------------------------------------------------

def training_frame(profiles: DataFrame, intercept: float = C.LABEL_INTERCEPT) -> DataFrame:
    """CustomerID (key only), the 8 features, ChurnBinary, split, fold."""
    # de-duplicated once: the label's min/max, the class counts and the
    # ranking all read it
    labeled = churn_label(profiles.dropDuplicates().checkpoint(eager=True), intercept=intercept)
    x = labeled.select("CustomerID", *C.ALL_FEATURES, "ChurnBinary")
    check_no_leakage([c for c in x.columns if c not in ("CustomerID", "ChurnBinary")])
    return stratified_split(x)


# --- M2, M3, M4 (M5: features) ---------------------------------------------------------------------------

def medians(fit_rows: DataFrame, cols: list[str]) -> DataFrame:
    """1-row frame of exact medians (distributed exact quantiles)."""
    return quantile_row(fit_rows, {c: c for c in cols}, [0.5], {c: [f"med_{c}"] for c in cols})


def impute_numeric(df: DataFrame, med: DataFrame, cols: list[str]) -> DataFrame:
    x = df.crossJoin(F.broadcast(med))
    for c in cols:
        x = x.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")))
    return x.drop(*med.columns)


def scaler_stats(fit_rows: DataFrame, cols: list[str]) -> DataFrame:
    """1-row mean and population σ per column."""
    return fit_rows.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols],
                        *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols])


def standardize(df: DataFrame, st: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / σ with σ = 0 → 0 (a constant column)."""
    x = df.crossJoin(F.broadcast(st))
    for c in cols:
        sd = F.col(f"sd_{c}")
        x = x.withColumn(c, F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(0.0))
                         .otherwise((F.col(c).cast("double") - F.col(f"mu_{c}")) / sd))
    return x.drop(*st.columns)


def mode_of(fit_rows: DataFrame, col: str) -> DataFrame:
    """1-row (mode, count): most frequent non-null value, ties to the smallest."""
    return (fit_rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
                    .orderBy(F.col("count").desc(), F.col(col)).limit(1)
                    .select(F.col(col).alias("mode"), "count"))


def impute_mode(df: DataFrame, mode: DataFrame, col: str) -> DataFrame:
    return (df.crossJoin(F.broadcast(mode.select(F.col("mode").alias("_mode"))))
              .withColumn(col, F.coalesce(F.col(col), F.col("_mode"))).drop("_mode"))


def feature_names(onehot_cols: list[str]) -> list[str]:
    """M6: numeric features then the one-hot columns."""
    return list(C.NUMERIC_FEATURES) + list(onehot_cols)
