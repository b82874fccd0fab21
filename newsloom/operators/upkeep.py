"""Upkeep of a store: what broken runs left behind, small files, and logs that only grow."""

from __future__ import annotations

from collections import Counter
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import journal
from newsloom.operators.tables import (
    RECENT,
    bucket_of,
    counts_of,
    current_sources,
    link_counts_of,
    on_days,
    read_table,
    writer_of,
)
from newsloom.session import drop_scratch, scratch_dir, written

BASE = "base"  # the run of compacted rows
ORDER = {"articles": "url", "article_categories": "article_id"}  # within a day


def recover(spark: SparkSession, path: str) -> None:
    """Bring a store in order whose last writer broke off. An article row commits an insert, so the keys of a run
    that did not end count as far as their articles are there; without any, they go. A rewrite of
    a table is done again from its copy. Every step can be repeated."""
    for name, table, copy in journal.rewrites(spark, path):
        _overwrite(spark, path, table, copy)
        journal.finish_rewrite(spark, path, name)
    for run in journal.pending(spark, path):
        _settle(spark, path, run)
        journal.finish(spark, path, run)


def _settle(spark: SparkSession, path: str, run: str) -> None:
    folders = [f"{path}/article_keys/bucket={RECENT}/run={run}", f"{path}/article_counts/run={run}"]
    if journal.exists(spark, folders[0]):
        keys = read_table(spark, path, "article_keys").filter((F.col("bucket") == RECENT) & (F.col("run") == run))
        articles = on_days(read_table(spark, path, "articles"), keys).select("id", "url", "date_day", "source_id")
        there = written(articles.join(keys.select("id", "url"), ["id", "url"], "left_semi"), "there")
        if not keys.join(there, "id", "left_anti").isEmpty():
            # Part of the run's articles, or none: keys and counts of these only.
            links = on_days(read_table(spark, path, "article_categories"), keys)
            links = links.join(there.select(F.col("id").alias("article_id")), "article_id", "left_semi").distinct()
            kept = keys.join(there.select("id"), "id", "left_semi")
            # The counts first: the keys say whether there is anything left to do.
            counts = counts_of(there, run).unionByName(link_counts_of(links, run))
            for table, rows in (("article_counts", counts), ("article_keys", kept)):
                rows, copy = _copied(rows, table)
                writer_of(table, rows, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{table}")
                drop_scratch(spark, [copy])
            if there.isEmpty():
                for folder in folders:
                    journal.remove(spark, folder)
    elif journal.exists(spark, folders[1]):
        journal.remove(spark, folders[1])


def _copied(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _overwrite(spark: SparkSession, path: str, table: str, copy: str) -> None:
    """Replace a table by its copy; of tables by day, the days that the copy has."""
    rows = spark.read.parquet(copy)
    if table in ORDER:
        order = ["date_day", ORDER[table]]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = writer_of(table, rows, "overwrite").option("partitionOverwriteMode", "dynamic")
    elif table == "article_keys":
        rows = rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
        writer = writer_of(table, rows, "overwrite")
    else:
        writer = writer_of(table, rows.coalesce(1) if table == "sources" else rows, "overwrite")
    writer.parquet(f"{path}/{table}")


def _rewritten(spark: SparkSession, path: str, table: str, rows: DataFrame) -> None:
    _, copy = _copied(rows, table)
    name = journal.begin_rewrite(spark, path, table, copy)
    _overwrite(spark, path, table, copy)
    journal.finish_rewrite(spark, path, name)
    drop_scratch(spark, [copy])


def files_by_day(spark: SparkSession, path: str, table: str) -> Counter:
    """How many files each day of a table has, from the listing that any read of it makes."""
    days = Counter()
    for file in read_table(spark, path, table).inputFiles():
        for part in unquote(file).split("/"):
            if part.startswith("date_day="):
                days[part.removeprefix("date_day=")] += 1
    return days


def compact_store(spark: SparkSession, path: str, most_files: int = 1) -> None:
    """Rewrite what appends have scattered; every table keeps its rows.

    Days of articles and links with more than ``most_files`` files become few files sorted by URL and article, so a
    lookup skips most row groups. The log of sources becomes one row per source. Keys are sorted into the buckets of
    their ids, and counts added up by day. Tables are written to the shared folder first and then replaced,
    with a marker in between: a run that breaks off is completed by the next one (:func:`recover`). One writer
    at a time; readers have to wait for the end.
    """
    recover(spark, path)
    for table in ORDER:
        days = [day for day, n in files_by_day(spark, path, table).items() if n > most_files]
        if days:
            rows = read_table(spark, path, table).filter(F.col("date_day").isin([date.fromisoformat(day) for day in sorted(days)]))
            _rewritten(spark, path, table, rows)
    log = read_table(spark, path, "sources")
    _rewritten(spark, path, "sources", current_sources(log))
    keys = read_table(spark, path, "article_keys")
    compacted = keys.dropDuplicates(["id", "url"]).withColumns({"bucket": bucket_of(F.col("url")), "run": F.lit(BASE)})
    _rewritten(spark, path, "article_keys", compacted)
    counts = read_table(spark, path, "article_counts").groupBy("date_day", "source_id", "category_id")
    _rewritten(spark, path, "article_counts", counts.agg(F.sum("n").alias("n")).withColumn("run", F.lit(BASE)))
