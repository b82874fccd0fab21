"""Incremental ingest, deduplication with a horizon, daily counts."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.plans.ingest import ingest

HORIZON = "7 days"


def stream_into_store(
    articles: DataFrame,
    path: str,
    checkpoint: str,
    as_of: datetime | str,
    feeds: DataFrame | None = None,
) -> StreamingQuery:
    """Ingest every micro-batch of normalised ``articles`` and stop at the end of
    the landed files. Replaying a micro-batch adds nothing, so inserts happen once.

    Rows that cannot be stored go, with their reason, to ``path``/rejects, and each
    batch's counters to ``path``/counters, one folder per stream and batch. The stream is named by the id in its
    checkpoint: a new checkpoint, whose batches start at 0 again, replaces nothing."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        noted = batch.sparkSession.read.text(f"{checkpoint}/metadata", wholetext=True).first().value
        stream = json.loads(noted)["id"]
        result = ingest(path, batch, as_of, feeds)
        for name, rows in (("rejects", result.rejects), ("counters", result.counters)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/stream={stream}/batch_id={batch_id}")

    return (
        articles.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_by_url(articles: DataFrame, horizon: str | None = HORIZON) -> DataFrame:
    """The first article per URL. With a ``horizon`` a URL is remembered so long after its
    arrival (``scraped_at``), which publishers cannot set: a date in the future or long past makes nothing
    late. With ``horizon=None``, and for rows without ``scraped_at``, a URL is remembered for good."""
    if horizon is None or "scraped_at" not in articles.columns:
        return articles.dropDuplicates(["url"])
    timed = articles.filter("scraped_at is not null").withWatermark("scraped_at", horizon)
    untimed = articles.filter("scraped_at is null").dropDuplicates(["url"])
    return timed.dropDuplicatesWithinWatermark(["url"]).unionByName(untimed)


def daily_counts(articles: DataFrame, closing: str | None = None) -> DataFrame:
    """Articles per UTC day and source; undated ones under a NULL day. The state is one
    row per day and source, so no article is ever too late.

    With ``closing`` a day is put out once (append mode), when articles dated so much later have
    arrived; what comes after that is not in it. A date after the arrival (``scraped_at``)
    counts as the arrival, so that it closes no day early."""
    count = F.count(F.lit(1)).alias("n")
    if closing is None:
        return articles.groupBy(F.to_date("date").alias("day"), "source").agg(count)
    if "scraped_at" in articles.columns:
        articles = articles.withColumn("date", F.least("date", "scraped_at"))
    days = articles.withWatermark("date", closing).groupBy(F.window("date", "1 day"), "source").agg(count)
    return days.select(F.to_date("window.start").alias("day"), "source", "n")
