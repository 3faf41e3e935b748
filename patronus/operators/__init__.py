"""patronus.operators."""
