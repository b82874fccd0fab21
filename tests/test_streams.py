"""Streams over several files, with repeats and late rows, against the batch result."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import parse_date
from newsloom.operators.normalize import entry_to_raw, normalize_articles
from newsloom.operators.tables import read_store
from newsloom.session import scratch_dir
from newsloom.sources import read_articles, read_rss, rss_entries
from newsloom.streaming import daily_counts, dedup_by_url, stream_into_store

SCHEMA = "url string, source string, date timestamp"
FIRST_DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """One file per day, in modification order; each day's file comes twice."""
    folder = tmp_path_factory.mktemp("days")
    rows, mtime = [], 1_700_000_000
    for day in range(12):
        lines = []
        for i in range(20):
            moment = FIRST_DAY + timedelta(days=day, hours=i)
            row = (f"https://a.com/{day}/{i}", f"s{i % 3}", moment.isoformat())
            rows.append(row)
            lines.append('{"url":"%s","source":"%s","date":"%s"}' % row)
        for copy in range(2):
            target = folder / f"{day:02d}-{copy}.json"
            target.write_text("\n".join(lines))
            mtime += 10
            os.utime(target, (mtime, mtime))
    return str(folder), rows


def run(spark, stream, mode):
    path = scratch_dir(spark, "stream")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/b={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 5).json(folder)


def test_dedup_over_batches(spark, landed):
    folder, rows = landed
    out = run(spark, dedup_by_url(stream_of(spark, folder)), "append")
    assert sorted(r.url for r in out.collect()) == sorted(row[0] for row in rows)


def test_daily_counts_updates_reach_the_batch_result(spark, landed):
    folder, rows = landed
    out = run(spark, daily_counts(stream_of(spark, folder)), "update")
    final = out.groupBy("day", "source").agg(F.max_by("n", "batch").alias("n"))
    batch = spark.read.schema(SCHEMA).json(folder).groupBy(F.to_date("date").alias("day"), "source").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in final.collect()} == {tuple(r) for r in batch.collect()}


def test_daily_counts_append_closed_days_only(spark, landed):
    folder, rows = landed
    out = run(spark, daily_counts(stream_of(spark, folder), "7 days"), "append")
    days = {r.day for r in out.collect()}
    closed_before = (FIRST_DAY + timedelta(days=11, hours=19) - timedelta(days=7)).date()
    assert days and max(days) < closed_before
    assert all(r.n in (14, 12) for r in out.collect())


ITEM = "<item><title>T{0}</title><link>https://a.com/{0}</link><category>AI</category><pubDate>{1}</pubDate></item>"


def test_rss_files_stream_into_the_store(spark, tmp_path):
    """A file that repeats an item arrives later; a restart goes on where it stopped."""
    feed, store, checkpoint = tmp_path / "feed", scratch_dir(spark, "store"), scratch_dir(spark, "checkpoint")
    feed.mkdir()

    def run():
        entries = rss_entries(read_rss(spark, str(feed), stream=True))
        articles = normalize_articles(entry_to_raw(entries, "2024-01-31", F.lit("A")))
        stream_into_store(articles, store, checkpoint, "2024-01-31").awaitTermination()
        return sorted((r.title, str(r.date)) for r in read_store(spark, store).articles.collect())

    one = ITEM.format(1, "Tue, 30 Jan 2024 10:00:00 +0200")
    (feed / "a.xml").write_text(f"<rss><channel>{one}</channel></rss>")
    first = [("T1", "2024-01-30 08:00:00")]
    assert run() == first
    (feed / "b.xml").write_text(f"<rss><channel>{one}{ITEM.format(2, 'soon')}</channel></rss>")
    assert run() == first + [("T2", "None")]
    assert run() == first + [("T2", "None")]


def test_json_files_stream_with_undated_articles(spark, tmp_path):
    line = '{"title":"T%d","url":"https://a.com/%d","scraped_at":"2024-01-30T10:00:00Z"}\n'
    (tmp_path / "a.json").write_text(line % (1, 1) + line % (2, 2))
    (tmp_path / "b.json").write_text(line % (3, 1))
    raw = read_articles(spark, str(tmp_path), json_lines=True, stream=True)
    timed = raw.select("url", parse_date(F.col("date")).alias("date"), parse_date(F.col("scraped_at")).alias("scraped_at"))
    out = run(spark, dedup_by_url(timed), "append")
    assert sorted(r.url for r in out.collect()) == ["https://a.com/1", "https://a.com/2"]


def test_wrong_dates_lose_nothing(spark, tmp_path):
    """A date far in the future, then older articles and a repeat: by arrival nothing is late."""
    days = ["2024-01-30", "2099-01-01", "2024-01-29", "2023-06-01", "2024-01-30"]
    for i, day in enumerate(days):
        target = tmp_path / f"{i}.json"
        target.write_text('{"url":"u%d","source":"s","date":"%sT00:00:00Z","scraped_at":"2024-02-0%dT00:00:00Z"}' % (i % 4, day, i + 1))
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA + ", scraped_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    out = run(spark, dedup_by_url(stream), "append")
    assert sorted(r.url for r in out.collect()) == ["u0", "u1", "u2", "u3"]
    counts = run(spark, daily_counts(stream), "update").groupBy("day").agg(F.max_by("n", "batch").alias("n"))
    assert sorted((str(r.day), r.n) for r in counts.collect()) == [
        ("2023-06-01", 1), ("2024-01-29", 1), ("2024-01-30", 2), ("2099-01-01", 1),
    ]


def test_rejects_of_a_stream_are_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title":"T","url":"https://a.com/1"}\n{"title":"no url"}\n')
    store = scratch_dir(spark, "store")
    articles = normalize_articles(read_articles(spark, str(tmp_path), json_lines=True, stream=True))
    stream_into_store(articles, store, scratch_dir(spark, "checkpoint"), "2024-01-31").awaitTermination()
    (reject,) = spark.read.parquet(f"{store}/rejects").collect()
    assert (reject.title, reject.reason) == ("no url", "url missing or malformed")
    (counters,) = spark.read.parquet(f"{store}/counters").collect()
    assert (counters.processed, counters.inserted, counters.rejected) == (2, 1, 1)


def test_rejects_survive_a_new_checkpoint(spark, tmp_path):
    """Batches of a second stream start at 0 again and replace nothing."""
    store, found = scratch_dir(spark, "store"), []
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text('{"title":"no url of %s"}\n' % name)
        raw = read_articles(spark, str(tmp_path / name), json_lines=True, stream=True)
        stream_into_store(normalize_articles(raw), store, scratch_dir(spark, "checkpoint"), "2024-01-31").awaitTermination()
        found.append(sorted(r.title for r in spark.read.parquet(f"{store}/rejects").collect()))
    assert found == [["no url of a"], ["no url of a", "no url of b"]]
    assert spark.read.parquet(f"{store}/counters").count() == 2
