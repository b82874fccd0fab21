"""Sources: lookup in the feed list, groups, fallback URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import slugify


def match_feeds(sources: DataFrame, feeds: DataFrame, name: str = "source") -> DataFrame:
    """Every source with the feed whose name has the same slug, and ``matched``.

    The feed with the lowest ``seq`` wins. Sources without a feed stay, with
    NULL ``feed_url``, so that they can be reported.
    """
    first = feeds.groupBy(slugify(F.col("name")).alias("_key")).agg(
        F.min_by(F.struct("name", "url"), "seq").alias("_feed")
    )
    joined = sources.withColumn("_key", slugify(F.col(name))).join(first, "_key", "left")
    return joined.select(
        *[F.col(column) for column in sources.columns],
        F.col("_feed.name").alias("feed_name"),
        F.col("_feed.url").alias("feed_url"),
        F.col("_feed").isNotNull().alias("matched"),
    )


def group_by_source(articles: DataFrame) -> DataFrame:
    """Articles per source, with the dates they span."""
    return articles.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def first_url_per_source(articles: DataFrame, order: str = "seq") -> DataFrame:
    """The URL of each source's first article."""
    return articles.groupBy("source").agg(F.min_by("url", order).alias("source_url"))
