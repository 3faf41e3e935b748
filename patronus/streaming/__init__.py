"""patronus.streaming."""
