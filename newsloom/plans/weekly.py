"""The weekly run: feeds to landed files, files to store, store to documents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import parse_date
from newsloom.operators.normalize import entry_to_raw, keep_recent, normalize_articles
from newsloom.operators.summary import TextModel
from newsloom.operators.tables import read_store
from newsloom.plans.digest import FAN_IN, digest_pieces, digest_requests, full_article_list
from newsloom.plans.ingest import IngestResult, ingest
from newsloom.plans.retrieval import window_articles
from newsloom.session import written
from newsloom.sources import read_articles, write_by_source, write_digest, write_full_list


def land_feeds(entries: DataFrame, path: str, as_of: datetime | str, days: int = 7) -> None:
    """Feed entries (with ``source``) as raw articles, one folder per source,
    keeping recent and undated ones."""
    raw = entry_to_raw(entries, as_of).withColumn("date", parse_date(F.col("date")))
    recent = keep_recent(raw, as_of, days)
    texts = {
        name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX") for name in ("date", "scraped_at")
    }
    write_by_source(recent.withColumns(texts), path)


def ingest_landed(
    spark: SparkSession,
    landed: str,
    store: str,
    as_of: datetime | str,
    feeds: DataFrame | None = None,
    summarize: Callable[[DataFrame], DataFrame] | None = None,
) -> IngestResult:
    """Normalise all landed articles and insert the new ones."""
    raw = read_articles(spark, landed, json_lines=True, with_place=True)
    return ingest(store, normalize_articles(raw), as_of, feeds, summarize)


def publish_week(
    spark: SparkSession,
    store: str,
    out: str,
    as_of: datetime | str,
    load_model: Callable[[], TextModel],
    days: int = 7,
    fan_in: int | None = FAN_IN,
) -> DataFrame:
    """Write the digest and the full list of the week's articles, and return
    these. The store is queried once."""
    page = written(window_articles(read_store(spark, store), as_of, days), "week")
    requests = digest_requests(page, as_of, days)
    write_digest(digest_pieces(requests, load_model, as_of, days, fan_in=fan_in), f"{out}/digest_hebdo", as_of)
    write_full_list(full_article_list(page), f"{out}/articles_complets", as_of)
    return page
