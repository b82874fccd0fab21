"""From feed entries and raw articles to normalised articles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.clock import days_before, instant, instant_like
from newsloom.functions import (
    clean_html,
    content_first,
    none_if_empty,
    normalize_categories,
    normalize_url,
    parse_date,
    parse_scraped,
)

UNKNOWN_SOURCE = "Unknown"


def entry_to_raw(entries: DataFrame, as_of: datetime | str, source: Column | None = None) -> DataFrame:
    """Feed entries as raw articles. ``source`` defaults to the entries' own."""
    content = content_first(F.col("content"), entries.schema["content"].dataType)
    return entries.select(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("link", F.lit("")).alias("url"),
        F.col("published").alias("date"),
        instant(as_of).alias("scraped_at"),
        (F.col("source") if source is None else source).alias("source"),
        "summary",
        "description",
        content.alias("content"),
        "author",
        "categories",
    )


def keep_recent(entries: DataFrame, as_of: datetime | str, days: int = 7, column: str = "date") -> DataFrame:
    """Entries of the last ``days`` days, to the second, and undated ones."""
    limit = instant_like(entries, column, days_before(as_of, days))
    return entries.filter(F.col(column).isNull() | (F.col(column) >= limit))


def normalize_articles(raw: DataFrame) -> DataFrame:
    """Canonical columns, each cleaned; absent and empty values are NULL, except
    ``categories``, which is then an empty list. ``seq`` is kept. Drops no row."""

    def given(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    def text(name: str) -> Column:
        return none_if_empty(clean_html(given(name)))

    def url(name: str) -> Column:
        return none_if_empty(normalize_url(given(name)))

    def moment(name: str, parse: Callable[[Column], Column]) -> Column:
        is_text = name not in raw.columns or raw.schema[name].dataType.typeName() == "string"
        return parse(given(name)) if is_text else F.col(name)

    categories = given("categories")
    if "categories" not in raw.columns or raw.schema["categories"].dataType.typeName() == "string":
        categories = F.when(categories.isNotNull(), F.array(categories))

    return raw.select(
        text("title").alias("title"),
        url("url").alias("url"),
        none_if_empty(given("source")).alias("source"),
        moment("scraped_at", parse_scraped).alias("scraped_at"),
        moment("date", parse_date).alias("date"),
        text("author").alias("author"),
        text("summary").alias("summary"),
        text("description").alias("description"),
        text("content").alias("content"),
        normalize_categories(categories).alias("categories"),
        url("image_url").alias("image_url"),
        *[F.col(name) for name in ("seq",) if name in raw.columns],
    )


def reject_reason() -> Column:
    """Why a normalised article cannot be stored; NULL when it can."""
    return F.when(F.col("title").isNull(), "title missing").when(
        F.col("url").isNull(), "url missing or malformed"
    )


def split_rejects(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(storable rows, other rows with their ``reason``)."""
    marked = articles.withColumn("reason", reject_reason())
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def source_label(df: DataFrame, unknown: str = UNKNOWN_SOURCE) -> Column:
    """``source_name``, else ``source``, else ``unknown``."""
    known = [F.col(name) for name in ("source_name", "source") if name in df.columns]
    return F.coalesce(*known, F.lit(unknown))


def best_text(max_content: int = 2000, longer_than: int = 50) -> Column:
    """Struct (label, text) of the first of summary, description and content
    with more than ``longer_than`` characters; a longer content is cut at
    ``max_content``. NULL when none qualifies."""

    def candidate(name: str, label: str, text: Column) -> Column:
        value = F.struct(F.lit(label).alias("label"), text.alias("text"))
        return F.when(F.length(name) > longer_than, value)

    content = F.col("content")
    cut = F.when(
        F.length(content) > max_content,
        F.concat(F.substring(content, 1, max_content), F.lit("...")),
    ).otherwise(content)
    return F.coalesce(
        candidate("summary", "Résumé", F.col("summary")),
        candidate("description", "Description", F.col("description")),
        candidate("content", "Contenu", cut),
    )


def title_fallback(articles: DataFrame) -> DataFrame:
    """When no article of the set has content or summary, titles become content."""
    has_text = (F.length(F.coalesce("content", F.lit(""))) > 0) | (
        F.length(F.coalesce("summary", F.lit(""))) > 0
    )
    any_text = articles.agg(F.coalesce(F.bool_or(has_text), F.lit(False)).alias("any_text")).scalar()
    return articles.withColumn("content", F.when(any_text, F.col("content")).otherwise(F.col("title")))
