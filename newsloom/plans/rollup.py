"""The statistics of a store from what each ingest added, without reading an article or a link."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.clock import day_start, days_before
from newsloom.operators.tables import UNDATED_DAY, StoreTables


def _articles(store: StoreTables) -> DataFrame:
    return store.counts.filter("source_id is not null")


def _named(names: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every name with its count, most first; names without any count 0."""
    summed = counts.groupBy(F.col(key).alias("id")).agg(F.sum("n").alias("n"))
    return (
        names.select("id", "name")
        .join(summed, "id", "left")
        .select("name", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy(F.desc("n"), "name")
    )


def totals(store: StoreTables) -> DataFrame:
    """One row: articles, sources, categories."""
    n_articles = _articles(store).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    n_sources, n_categories = (
        rows.agg(F.count(F.lit(1)).alias("n")).scalar() for rows in (store.sources, store.categories)
    )
    return store.counts.sparkSession.range(1).select(
        n_articles.alias("total_articles"),
        n_sources.alias("total_sources"),
        n_categories.alias("total_categories"),
    )


def by_source(store: StoreTables) -> DataFrame:
    """Articles per source, most first; sources without articles count 0."""
    return _named(store.sources, _articles(store), "source_id")


def by_category(store: StoreTables) -> DataFrame:
    """Articles per category, most first; unused categories count 0."""
    return _named(store.categories, store.counts.filter("category_id is not null"), "category_id")


def by_day(store: StoreTables, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Articles per day of the window, newest day first. The window starts with a day, so whole days are enough."""
    first = day_start(days_before(as_of, days)).date()
    return (
        _articles(store)
        .filter((F.col("date_day") >= first) & (F.col("date_day") != date.fromisoformat(UNDATED_DAY)))
        .groupBy(F.col("date_day").alias("day"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("day"))
    )
