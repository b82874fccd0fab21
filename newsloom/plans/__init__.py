"""Queries over the store, and the ingest that fills it."""
