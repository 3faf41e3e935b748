"""Rule scoring (S1) and model scoring (S2) on streams.

The rule scorer is a stateless projection against a static 1-row
statistics frame, so the same function runs on a ``readStream`` frame: the
statistics side is broadcast into every micro-batch (a stream–static join
with a 1-row side), no state store is needed and no watermark applies.

A saved model is a Spark ML pipeline of projections, so it scores a stream of customer
features as it scores a table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronus import config as C
from patronus.functions.numeric import rnd
from patronus.operators.rfm import score_rule

REQUEST_SCHEMA = T.StructType([T.StructField("request_id", T.LongType()),
                               T.StructField("recency", T.DoubleType()),
                               T.StructField("frequency", T.DoubleType()),
                               T.StructField("monetary", T.DoubleType())])


def score_request_stream(spark: SparkSession, source_dir: str, stats: DataFrame,
                         fmt: str = "json") -> DataFrame:
    """Streaming frame of scored requests read from files in ``source_dir``."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).format(fmt).load(source_dir)
    return score_rule(stream, stats)


def feature_schema() -> T.StructType:
    """The columns a stream of customers for model scoring has."""
    return T.StructType([T.StructField("CustomerID", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in C.NUMERIC_FEATURES],
                         T.StructField("Country", T.StringType())])


def score_with_model(customers: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """(CustomerID, churn_probability, churn_risk, model_used) of a table or a stream of
    customer features."""
    p = F.col("score")
    return pipeline.transform(customers).select(
        "CustomerID", rnd(p, 6).alias("churn_probability"),
        F.when(p > C.PROB_HIGH, "High").when(p > C.PROB_MEDIUM, "Medium").otherwise("Low").alias("churn_risk"),
        F.lit(pipeline.stages[0].model_name).alias("model_used"))


def start_scoring(scored: DataFrame, sink_dir: str, checkpoint_dir: str, fmt: str = "parquet"):
    """Append scored requests to files; the checkpoint folder makes the
    query restartable after a failure (exactly-once file sink)."""
    return (scored.writeStream.format(fmt).option("path", sink_dir)
                  .option("checkpointLocation", checkpoint_dir).outputMode("append").start())
