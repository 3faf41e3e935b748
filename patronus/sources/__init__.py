"""patronus.sources."""
