"""Data of the report page: counters and the newest rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.clock import instant_like
from newsloom.operators.normalize import source_label
from newsloom.plans.retrieval import newest_order

# What the report shows for a missing title, link or summary.
NO_TITLE = "Sans titre"
NO_LINK = "#"
NO_SUMMARY = "Aucun résumé disponible"


def this_week(articles: DataFrame, as_of: datetime | str) -> Column:
    """Age of at most 7 whole days; future dates count."""
    now = instant_like(articles, "date", as_of).cast("timestamp")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("date").cast("timestamp"))
    return F.coalesce(F.floor(age / 86400) <= 7, F.lit(False))


def report_sources(articles: DataFrame, as_of: datetime | str) -> DataFrame:
    """(source, n_articles, this_week) of every source in the report."""
    return (
        articles.select(source_label(articles).alias("source"), this_week(articles, as_of).alias("_week"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_articles"), F.count_if("_week").alias("this_week"))
    )


def report_counters(articles: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row over the report's articles: total, sources, this week."""
    counts = report_sources(articles, as_of).agg(
        F.sum("n_articles").alias("total"), F.count(F.lit(1)).alias("n_sources"), F.sum("this_week").alias("week")
    )
    return counts.select(
        F.coalesce("total", F.lit(0)).cast("long").alias("total_articles"),
        "n_sources",
        F.coalesce("week", F.lit(0)).cast("long").alias("this_week"),
    )


def newest_report_rows(articles: DataFrame, shown: int = 40) -> DataFrame:
    """The first ``shown`` rows as the page shows them."""
    summaries = [F.col(name) for name in ("summary", "description") if name in articles.columns]
    return (
        articles.orderBy(*newest_order())
        .limit(shown)
        .select(
            "id",
            F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
            F.coalesce("url", F.lit(NO_LINK)).alias("url"),
            source_label(articles).alias("source"),
            F.coalesce(F.date_format("date", "dd/MM/yyyy 'à' HH:mm"), F.lit("")).alias("date_shown"),
            F.coalesce(*summaries, F.lit(NO_SUMMARY)).alias("summary"),
        )
    )
