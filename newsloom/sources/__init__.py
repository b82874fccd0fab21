"""Readers of landed files and writers of results."""

from newsloom.sources.feeds import atom_entries, read_atom, read_feed_list, read_rss, rss_entries
from newsloom.sources.files import (
    broken_articles,
    latest_digest,
    newest_first,
    read_articles,
    union_batches,
    write_articles,
    write_by_source,
    write_digest,
    write_full_list,
)

__all__ = [
    "atom_entries",
    "broken_articles",
    "latest_digest",
    "newest_first",
    "read_articles",
    "read_atom",
    "read_feed_list",
    "read_rss",
    "rss_entries",
    "union_batches",
    "write_articles",
    "write_by_source",
    "write_digest",
    "write_full_list",
]
