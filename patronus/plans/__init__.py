"""patronus.plans."""
