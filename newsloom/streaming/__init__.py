"""Structured Streaming forms of the incremental work."""

from newsloom.streaming.incremental import daily_counts, dedup_by_url, stream_into_store

__all__ = ["daily_counts", "dedup_by_url", "stream_into_store"]
