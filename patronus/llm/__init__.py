"""Operators and queries for large-scale training-data pipelines."""
