"""The store tables on Parquet, and the set-based writes to them.

``articles`` and ``article_categories`` are partitioned by ``date_day``; ``sources`` is a log whose current
state is the last row per name. ``article_keys`` and ``article_counts`` are derived from them by every
ingest: where an article is, and what each run added.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from newsloom.clock import instant
from newsloom.operators import journal
from newsloom.operators.dedup import absent_from
from newsloom.schemas import ARTICLE, CATEGORY, COUNT, KEY, LINK, SOURCE
from newsloom.session import written

SCHEMAS = {
    "sources": SOURCE,
    "articles": ARTICLE,
    "categories": CATEGORY,
    "article_categories": LINK,
    "article_keys": KEY,
    "article_counts": COUNT,
}
PARTITIONED = {
    "articles": ["date_day"],
    "article_categories": ["date_day"],
    "article_keys": ["bucket", "run"],
    "article_counts": ["run"],
}
DERIVED = ("article_keys", "article_counts")
KEY_BUCKETS = 256
RECENT = -1  # the bucket of keys that were not compacted yet

# Undated articles share a day of their own: joins on the day, which is how
# days are pruned, would lose a NULL.
UNDATED_DAY = "1900-01-01"


class StoreTables(NamedTuple):
    articles: DataFrame
    sources: DataFrame
    categories: DataFrame
    links: DataFrame
    keys: DataFrame | None = None
    counts: DataFrame | None = None


def surrogate_key(natural_key: Column) -> Column:
    """Deterministic BIGINT key. The natural key stays the truth: ingest rejects
    a row whose key is taken by another natural key."""
    return F.xxhash64(natural_key)


def partition_day(date: Column) -> Column:
    """The ``date_day`` of an article."""
    return F.coalesce(F.to_date(date), F.lit(UNDATED_DAY).cast("date"))


def writer_of(table: str, rows: DataFrame, mode: str) -> DataFrameWriter:
    """URLs get a Parquet bloom filter, for lookups."""
    writer = rows.select(*SCHEMAS[table].fieldNames()).write.mode(mode)
    if table in PARTITIONED:
        writer = writer.partitionBy(*PARTITIONED[table])
    if table == "articles":
        writer = writer.option("parquet.bloom.filter.enabled#url", "true")
    return writer


def append(table: str, rows: DataFrame, path: str, run: str | None = None) -> None:
    """Append to a store table, in as few files as their size allows. Articles and links that belong to no ``run``
    are one of their own: their keys and counts are appended first."""
    if run is None and table in ("articles", "article_categories"):
        spark = rows.sparkSession
        rows, run = written(rows.select(*SCHEMAS[table].fieldNames()), table), journal.begin(spark, path)
        if table == "articles":
            append("article_keys", keys_of(rows, run), path)
        append("article_counts", counts_of(rows, run) if table == "articles" else link_counts_of(rows, run), path)
        append(table, rows, path, run)
        journal.finish(spark, path, run)
        return
    days = [F.col(name) for name in PARTITIONED.get(table, ()) if table not in DERIVED]
    writer_of(table, rows.hint("rebalance", *days), "append").parquet(f"{path}/{table}")


def bucket_of(url: Column) -> Column:
    """Equal ids are equal hashes of URLs, so they share a bucket."""
    return F.pmod(surrogate_key(url), F.lit(KEY_BUCKETS)).cast("int")


def keys_of(articles: DataFrame, run: str) -> DataFrame:
    """Rows of the key index for new articles."""
    return articles.select("id", "url", "date_day", F.lit(RECENT).alias("bucket"), F.lit(run).alias("run"))


def counts_of(articles: DataFrame, run: str) -> DataFrame:
    """What new articles add to the counts."""
    counted = articles.groupBy("date_day", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"category_id": F.lit(None).cast("long"), "run": F.lit(run)})


def link_counts_of(links: DataFrame, run: str) -> DataFrame:
    """What new links (category_id, date_day) add to the counts."""
    counted = links.groupBy("date_day", "category_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"source_id": F.lit(None).cast("long"), "run": F.lit(run)})


def in_buckets(keys: DataFrame, urls: DataFrame) -> DataFrame:
    """The part of the key index that can hold ``urls``: their buckets, as a filter with literals, and what was
    not compacted yet. The driver sees one number per bucket."""
    buckets = sorted(r.bucket for r in urls.select(bucket_of(F.col("url")).alias("bucket")).distinct().collect())
    return keys.filter(F.col("bucket").isin(RECENT, *buckets))


def create_store(spark: SparkSession, path: str) -> None:
    """Create the tables that do not exist yet; existing ones are left alone. The derived tables of a store
    that has articles but no index are filled from it."""
    old = journal.exists(spark, f"{path}/articles") and not journal.exists(spark, f"{path}/article_keys")
    for table, schema in SCHEMAS.items():
        if not journal.exists(spark, f"{path}/{table}"):
            columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema]
            writer_of(table, spark.range(0).select(*columns), "ignore").parquet(f"{path}/{table}")
    if old:
        store = read_store(spark, path)
        append("article_counts", counts_of(store.articles, "base"), path)
        append("article_counts", link_counts_of(store.links, "base"), path)
        append("article_keys", keys_of(store.articles, "base"), path)


def current_sources(log: DataFrame) -> DataFrame:
    """Last URL per name; the first id and creation time stay."""
    return log.groupBy("name").agg(
        F.min_by("id", "created_at").alias("id"),
        F.max_by("url", F.struct("last_updated", "url")).alias("url"),
        F.max("last_updated").alias("last_updated"),
        F.min("created_at").alias("created_at"),
    ).select(*SOURCE.fieldNames())


def upsert_sources(existing: DataFrame, incoming: DataFrame, as_of: datetime | str) -> DataFrame:
    """State of ``sources`` after upserting (name, url) rows at ``as_of``.

    A known name keeps id and creation time and takes the new URL.
    """
    update = incoming.groupBy("name").agg(F.min("url").alias("url")).select(
        surrogate_key(F.col("name")).alias("id"),
        "name",
        "url",
        instant(as_of).alias("last_updated"),
        instant(as_of).alias("created_at"),
    )
    return current_sources(existing.unionByName(update))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")


def read_store(spark: SparkSession, path: str) -> StoreTables:
    """The tables as of the last ingest that ended. In a store made without an index it is None."""
    derived = [None, None]
    if journal.exists(spark, f"{path}/article_keys"):
        open_runs = journal.pending(spark, path)
        derived = [read_table(spark, path, table) for table in DERIVED]
        if open_runs:
            derived = [rows.filter(~F.col("run").isin(open_runs)) for rows in derived]
    return StoreTables(
        articles=read_table(spark, path, "articles"),
        sources=current_sources(read_table(spark, path, "sources")),
        categories=read_table(spark, path, "categories"),
        links=read_table(spark, path, "article_categories"),
        keys=derived[0],
        counts=derived[1],
    )


# As many days are named in a filter; more become a range.
NAMED_DAYS = 400


def on_days(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` of the days that occur in ``keys``, when both have ``date_day``: a filter with
    literals, so only these days' folders are read. The driver sees one value per day."""
    if "date_day" not in rows.columns or "date_day" not in keys.columns:
        return rows
    days = sorted(r.date_day for r in keys.select("date_day").distinct().collect() if r.date_day is not None)
    if len(days) <= NAMED_DAYS:
        return rows.filter(F.col("date_day").isin(days))
    return rows.filter(F.col("date_day").between(days[0], days[-1]))


def new_categories(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Category names of ``articles`` that the store does not have, with keys."""
    names = articles.select(F.explode("categories").alias("name")).distinct()
    return absent_from(names, categories, ["name"]).select(
        surrogate_key(F.col("name")).alias("id"), "name"
    )


def new_links(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct pairs that ``links`` does not have yet; only the days of ``pairs`` are read."""
    return absent_from(pairs.distinct(), on_days(links, pairs), pairs.columns)
