"""File sources with declared schemas.

CSV and JSON are read with an explicit ``StructType`` (no inference), so a
scan is one pass and types are stable.  JSON documents of nested maps are
turned into long tables with ``explode`` / ``posexplode`` (the position
keeps the document's listing order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

RFM_SCHEMA = T.StructType([
    T.StructField("CustomerID", L, False), T.StructField("Recency", I), T.StructField("Frequency", L),
    T.StructField("Monetary", D), T.StructField("AvgOrderValue", D), T.StructField("TotalItems", L),
    T.StructField("UniqueProducts", L), T.StructField("Cluster", I), T.StructField("Country", S),
    T.StructField("R_Score", I), T.StructField("F_Score", I), T.StructField("M_Score", I),
    T.StructField("RFM_Score", I), T.StructField("CLV", D), T.StructField("Segment", S),
    T.StructField("Recommendation", S), T.StructField("ChurnRisk", S), T.StructField("ChurnScore", D),
    T.StructField("ClusterLabel", S)])
EXPORT_SCHEMA = T.StructType([f for name in
                              ["CustomerID", "Recency", "Frequency", "Monetary", "CLV", "ChurnRisk",
                               "ChurnScore", "Segment", "RFM_Score", "Country", "AvgOrderValue",
                               "UniqueProducts", "Recommendation"]
                              for f in RFM_SCHEMA.fields if f.name == name])
MONTHLY_SCHEMA = T.StructType([T.StructField("Month", S), T.StructField("Revenue", D)])
PRODUCTS_SCHEMA = T.StructType([T.StructField("Product", S), T.StructField("Revenue", D)])
COUNTRY_SCHEMA = T.StructType([T.StructField("Country", S), T.StructField("Revenue", D)])
COUNT_MAP = T.MapType(S, L)
STATS_SCHEMA = T.StructType([
    T.StructField("total_customers", L), T.StructField("total_revenue", D), T.StructField("avg_clv", D),
    T.StructField("avg_order_value", D), T.StructField("high_churn_count", L),
    T.StructField("champions_count", L), T.StructField("segment_counts", COUNT_MAP),
    T.StructField("churn_counts", COUNT_MAP), T.StructField("cluster_counts", COUNT_MAP)])
POINT = T.StructType([T.StructField("Month", S), T.StructField("Revenue", D)])
FORECAST_SCHEMA = T.StructType([T.StructField("historical", T.ArrayType(POINT)),
                                T.StructField("forecast", T.ArrayType(POINT))])
METRIC_FIELDS = ["accuracy", "precision", "recall", "f1", "auc", "train_accuracy", "cv_accuracy", "cv_f1",
                 "cv_auc", "cv_train_accuracy", "cv_accuracy_gap", "accuracy_gap", "generalization_gap"]
RESULT_STRUCT = T.StructType([T.StructField(f, D) for f in METRIC_FIELDS]
                             + [T.StructField("overfitting", T.BooleanType()), T.StructField("train_time", D)])
RESULTS_SCHEMA = T.MapType(S, RESULT_STRUCT)


SPLIT_INFO_SCHEMA = T.StructType([
    T.StructField("total_samples", L), T.StructField("train_samples", L), T.StructField("test_samples", L),
    T.StructField("churn_rate_train", D), T.StructField("churn_rate_test", D),
    T.StructField("features_used", T.ArrayType(S)), T.StructField("leaky_features_removed", T.ArrayType(S)),
    T.StructField("smote_applied", T.BooleanType()), T.StructField("cv_folds", I), T.StructField("best_model", S)])
EXPLANATION_SCHEMA = T.StructType([
    T.StructField("best_model", S), T.StructField("best_model_f1", D), T.StructField("best_model_auc", D),
    T.StructField("highest_auc_model", S), T.StructField("highest_auc", D),
    T.StructField("overfit_models", T.ArrayType(S)), T.StructField("clean_models", T.ArrayType(S)),
    T.StructField("accuracy_range", T.StructType([T.StructField("min", D), T.StructField("max", D)])),
    T.StructField("explanation", T.StructType([T.StructField(t, S) for t in (
        "why_best_performed", "overfitting_analysis", "business_interpretation", "accuracy_range_note")]))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with RFC-4180 quoting (a quoted field may hold commas or
    doubled quotes)."""
    return (spark.read.schema(schema).option("header", True).option("quote", '"')
                 .option("escape", '"').option("mode", "FAILFAST").csv(path))


def read_rfm_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: the customer RFM table."""
    return read_csv(spark, path, RFM_SCHEMA)


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 13-column customer export (A10's output) with its declared schema."""
    return read_csv(spark, path, EXPORT_SCHEMA)


def read_monthly_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MONTHLY_SCHEMA)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PRODUCTS_SCHEMA)


def read_countries_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COUNTRY_SCHEMA)


def read_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """A5: the one-row statistics document (scalars + count maps)."""
    return spark.read.schema(STATS_SCHEMA).option("multiLine", True).json(path)


def stats_counts_long(stats: DataFrame) -> DataFrame:
    """(kind, key, count) from the three count maps, in document order."""
    parts = []
    for kind, col in (("segment", "segment_counts"), ("churn", "churn_counts"), ("cluster", "cluster_counts")):
        parts.append(stats.select(F.lit(kind).alias("kind"), F.posexplode(col).alias("pos", "key", "count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_explanation_json(spark: SparkSession, path: str) -> DataFrame:
    """The one-row explanation document."""
    return read_json_or_default(spark, path, EXPLANATION_SCHEMA)


def read_split_info_json(spark: SparkSession, path: str) -> DataFrame:
    """The one-row record of the split (no row where the file is missing)."""
    return read_json_or_default(spark, path, SPLIT_INFO_SCHEMA)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """(order, feature) of the feature list document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(S)).alias("f"))
    return doc.select(F.posexplode("f").alias("order", "feature"))


def read_forecast_json(spark: SparkSession, path: str) -> DataFrame:
    """(kind, idx, Month, Revenue) from the forecast document."""
    doc = spark.read.schema(FORECAST_SCHEMA).option("multiLine", True).json(path)
    h = doc.select(F.lit("historical").alias("kind"), F.posexplode("historical").alias("idx", "p"))
    f = doc.select(F.lit("forecast").alias("kind"), F.posexplode("forecast").alias("idx", "p"))
    return h.unionByName(f).select("kind", "idx", "p.Month", "p.Revenue")


def read_json_or_default(spark: SparkSession, path: str, schema: T.DataType,
                         multiline: bool = True) -> DataFrame:
    """The document at ``path``, or an empty frame of the schema when
    the file is missing."""
    st = schema if isinstance(schema, T.StructType) else T.StructType([T.StructField("value", schema)])
    try:
        return spark.read.schema(st).option("multiLine", multiline).json(path)
    except AnalysisException:
        return spark.createDataFrame([], st)


def read_model_results(spark: SparkSession, path: str) -> DataFrame:
    """model → metrics document as a long table (order, model, metrics…);
    empty when the file is missing."""
    cols = [T.StructField("order", I), T.StructField("model", S)] + list(RESULT_STRUCT.fields)
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.schema  # resolves the path
    except AnalysisException:
        return spark.createDataFrame([], T.StructType(cols))
    m = raw.select(F.from_json("value", RESULTS_SCHEMA).alias("m"))
    return m.select(F.posexplode("m").alias("order", "model", "r")).select("order", "model", "r.*")
