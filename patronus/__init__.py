"""patronus — Spark-native customer intelligence.

RFM profiles, scores and segments, lifetime value and churn risk, revenue
rollups and forecasts, dashboard aggregates, leak-free training data, churn
classifiers with cross-validation and over-sampling, and the evaluation
tables — all as DataFrame / SQL / MLlib jobs.
"""

from patronus.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
