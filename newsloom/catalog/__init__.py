"""The registered queries: every operator, on the given tables, with its SQL twin."""

from newsloom.catalog import digest, files, normalizing, store, streams, upkeep, weekly  # noqa: F401
from newsloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
