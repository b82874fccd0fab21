"""Batch ingest: normalised articles of any number of sources into the store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.clock import instant
from newsloom.operators import journal
from newsloom.operators.dedup import first_wins
from newsloom.operators.match import match_feeds
from newsloom.operators.normalize import UNKNOWN_SOURCE, reject_reason
from newsloom.operators.tables import (
    append,
    counts_of,
    create_store,
    in_buckets,
    keys_of,
    link_counts_of,
    new_categories,
    new_links,
    partition_day,
    read_store,
    surrogate_key,
)
from newsloom.operators.upkeep import recover
from newsloom.session import written


class IngestResult(NamedTuple):
    counters: DataFrame
    rejects: DataFrame


def ingest(
    path: str,
    batch: DataFrame,
    as_of: datetime | str,
    feeds: DataFrame | None = None,
    summarize: Callable[[DataFrame], DataFrame] | None = None,
    known_sources_only: bool = False,
) -> IngestResult:
    """Insert the articles whose URL the store at ``path`` does not have.

    Sources are upserted with their feed's URL (``feeds``); without a feed a stored URL stays, and a
    new source takes the URL of its first article. Of equal URLs the first row wins, by ``scraped_at``, then
    by ``seq``: the place in the landed files, if the batch has it. ``summarize`` fills ``summary`` of the new articles, which
    have unique ids. ``known_sources_only`` rejects articles whose source has no
    feed. Rows that cannot be stored are returned as ``rejects``.

    The batch is written to the shared folder first. Which of its rows are new is decided on (id, URL, time,
    place) and the buckets of the key index that hold its ids; texts are moved once, for the new rows. A batch without new
    rows adds to the log of sources only. Sources, categories,
    links, keys and counts are appended before the articles: an article row is what commits an insert. A run that
    broke off is settled by the next one (``operators.upkeep.recover``). The counters are observed on the writes.
    """
    spark = batch.sparkSession
    create_store(spark, path)
    recover(spark, path)
    store = read_store(spark, path)
    now = instant(as_of)

    if "seq" not in batch.columns:
        batch = batch.withColumn("seq", F.monotonically_increasing_id())
    batch = batch.withColumn("source", F.coalesce("source", F.lit(UNKNOWN_SOURCE)))
    reason = reject_reason()
    if known_sources_only and feeds is not None:
        batch = match_feeds(batch, feeds).drop("feed_name", "feed_url")
        reason = F.coalesce(reason, F.when(~F.col("matched"), "source not in the feed list"))
    seen, added = Observation(), Observation()
    one = F.lit(1)
    staged = written(
        batch.withColumns(
            {
                "scraped_at": F.coalesce("scraped_at", now),
                "reason": reason,
                "id": surrogate_key(F.col("url")),
                "_row": F.monotonically_increasing_id(),
            }
        )
        .drop("matched")
        .observe(seen, F.count(one).alias("processed"), F.count("reason").alias("rejected")),
        "batch",
    )
    # Same id and URL as in the store is a duplicate, same id and other URL a clash.
    keys = staged.filter("reason is null").select("id", "url", "scraped_at", "seq", "_row")
    asked = in_buckets(store.keys, keys).join(keys.select("id").distinct(), "id", "left_semi")
    asked = asked.select("id", F.col("url").alias("stored_url")).distinct()
    probed = first_wins(keys).join(asked, "id", "left")
    nth_url = F.row_number().over(Window.partitionBy("id").orderBy("url"))
    winners = (
        probed.filter("stored_url is null or stored_url <> url")
        .withColumn("clash", F.col("stored_url").isNotNull() | (nth_url > 1))
        .select("_row", "clash")
    )
    marked = _marked(staged, winners)
    # What the small tables need of the new rows; texts are read again where they are needed.
    new = written(
        marked.select("id", "url", "source", "date", "categories", "clash").observe(
            added, F.count(one).alias("found"), F.count_if("clash").alias("clashes")
        ),
        "new",
    )
    clashes = added.get["clashes"]
    inserted = added.get["found"] - clashes
    rejected = seen.get["rejected"] + clashes
    counters = spark.createDataFrame(
        [(seen.get["processed"], inserted, rejected, seen.get["processed"] - inserted - rejected)],
        "processed long, inserted long, rejected long, duplicates long",
    )
    rejects = staged.filter("reason is not null").drop("_row")
    if clashes:
        taken = marked.filter("clash").drop("clash", "reason", "_row")
        rejects = rejects.unionByName(taken.withColumn("reason", F.lit("id taken by another url")))
    if not inserted:
        _append_sources(path, staged, store.sources, feeds, as_of, known_sources_only)
        return IngestResult(counters, rejects)

    def stored(rows: DataFrame) -> DataFrame:
        return rows.filter("not clash").withColumns(
            {
                "source_id": surrogate_key(F.col("source")),
                "date_day": partition_day(F.col("date")),
                "created_at": now,
            }
        )

    fresh, articles = stored(new), stored(marked.drop("reason", "_row"))
    if summarize is not None:
        fresh = articles = written(summarize(articles), "summarized")
    pairs = fresh.select(
        F.col("id").alias("article_id"),
        F.explode("categories").alias("category"),
        "date_day",
    ).select("article_id", surrogate_key(F.col("category")).alias("category_id"), "date_day").distinct()

    run = journal.begin(spark, path)
    _together(
        spark,
        lambda: _append_sources(path, staged, store.sources, feeds, as_of, known_sources_only),
        lambda: append("categories", new_categories(fresh, store.categories), path),
        lambda: append("article_categories", new_links(pairs, store.links), path, run),
        lambda: append("article_counts", counts_of(fresh, run).unionByName(link_counts_of(pairs, run)), path),
        lambda: append("article_keys", keys_of(fresh, run), path),
    )
    append("articles", articles, path, run)
    journal.finish(spark, path, run)
    return IngestResult(counters, rejects)


def _marked(staged: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``staged`` that ``winners`` names by ``_row``, with their ``clash``.

    The numbers go as bitmaps of 32768 rows, a bit for each row of the batch, so that they are broadcast up to a batch of
    many millions and no text is shuffled; beyond that Spark joins them by bitmap."""
    bits = winners.groupBy(F.bitmap_bucket_number("_row").alias("_bitmap")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_row))").alias("_new"),
        F.expr("bitmap_construct_agg(bitmap_bit_position(_row)) filter (where clash)").alias("_clash"),
    )

    def is_set(bitmap: str) -> Column:
        byte = f"cast(conv(hex(substring({bitmap}, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
        return F.expr(f"coalesce((shiftright({byte}, cast(_bit % 8 as int)) & 1) = 1, false)")

    numbered = staged.withColumns(
        {"_bitmap": F.bitmap_bucket_number("_row"), "_bit": F.bitmap_bit_position("_row")}
    )
    found = numbered.join(written(bits, "winners"), "_bitmap").filter(is_set("_new"))
    return found.withColumn("clash", is_set("_clash")).select(*staged.columns, "clash")


def _together(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Writes that do not depend on each other, at the same time: small ones leave most of a cluster idle."""
    with ThreadPool(len(writes)) as pool:
        for ended in [pool.apply_async(inheritable_thread_target(spark)(write)) for write in writes]:
            ended.get()


def _append_sources(
    path: str,
    staged: DataFrame,
    stored: DataFrame,
    feeds: DataFrame | None,
    as_of: datetime | str,
    known_only: bool,
) -> None:
    """Log the batch's sources with id, URL and times. The URL is the feed's; without a feed
    the stored one stays; a new source takes that of its first article that can be stored."""
    first = F.struct(F.col("reason").isNotNull().alias("bad"), "scraped_at", "seq")
    found = staged.groupBy("source").agg(F.min_by("url", first).alias("first_url"))
    if feeds is None:
        named = found.withColumn("feed_url", F.lit(None).cast("string"))
    else:
        named = match_feeds(found, feeds)
        if known_only:
            named = named.filter("matched")
    known = stored.select(F.col("name").alias("source"), F.col("url").alias("stored_url"))
    named = named.join(known, "source", "left")
    now = instant(as_of)
    rows = named.select(
        surrogate_key(F.col("source")).alias("id"),
        F.col("source").alias("name"),
        F.coalesce("feed_url", F.nullif("stored_url", F.lit("")), "first_url", F.lit("")).alias("url"),
        now.alias("last_updated"),
        now.alias("created_at"),
    )
    append("sources", rows, path)
