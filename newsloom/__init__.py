"""Content monitoring on Spark: read, clean, deduplicate, store, query, digest."""
