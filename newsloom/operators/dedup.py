"""First writer wins, and insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(batch: DataFrame, key: str = "url", order: Sequence[str] = ("scraped_at", "seq")) -> DataFrame:
    """The first row of every key.

    Spark keeps one row per key and task before the shuffle, so a key that
    holds much of the batch stays cheap.
    """
    window = Window.partitionBy(key).orderBy(*[F.col(name).asc_nulls_last() for name in order])
    ranked = batch.withColumn("_rank", F.row_number().over(window))
    return ranked.filter("_rank = 1").drop("_rank")


def absent_from(batch: DataFrame, stored: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Rows of ``batch`` whose key ``stored`` does not have.

    Stored keys are first reduced to those the batch asks for. Then the build
    side of both joins is no larger than the batch, and a small batch is
    broadcast by Spark's own size check instead of shuffling the store. Repeated
    keys of the batch collapse before the shuffle.
    """
    keys = list(keys)
    asked = stored.select(*keys).join(batch.select(*keys).distinct(), keys, "left_semi")
    return batch.join(asked, keys, "left_anti")


def insert_if_absent(
    batch: DataFrame, stored: DataFrame, key: str = "url", order: Sequence[str] = ("scraped_at", "seq")
) -> DataFrame:
    """Rows that a sequential insert of ``batch`` would add to ``stored``."""
    return absent_from(first_wins(batch, key, order), stored, [key])
