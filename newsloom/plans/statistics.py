"""Counts over the store. Links and articles are counted before they join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.tables import StoreTables
from newsloom.plans.retrieval import recent_window


def totals(store: StoreTables) -> DataFrame:
    """One row: articles, sources, categories."""

    def rows(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    spark = store.articles.sparkSession
    return spark.range(1).select(
        rows(store.articles).alias("total_articles"),
        rows(store.sources).alias("total_sources"),
        rows(store.categories).alias("total_categories"),
    )


def _counted(names: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    counts = facts.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        names.select("id", "name")
        .join(counts, "id", "left")
        .select("name", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy(F.desc("n"), "name")
    )


def by_source(store: StoreTables) -> DataFrame:
    """Articles per source, most first; sources without articles count 0."""
    return _counted(store.sources, store.articles, "source_id")


def by_category(store: StoreTables) -> DataFrame:
    """Articles per category, most first; unused categories count 0."""
    return _counted(store.categories, store.links, "category_id")


def by_day(articles: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Articles per day of the window, newest day first."""
    return (
        recent_window(articles, as_of, days)
        .groupBy(F.to_date("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("day"))
    )
