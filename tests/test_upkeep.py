"""Compaction, the key index, counts by run, and what broken runs leave behind."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.operators import journal, tables, upkeep
from newsloom.operators.upkeep import compact_store, files_by_day, recover
from newsloom.plans import ingest as ingest_module
from newsloom.plans import retrieval, rollup, statistics
from newsloom.plans.ingest import ingest
from newsloom.session import scratch_dir, written
from test_store import article, batch, counters

DAY = "2024-01-31 09:00:00"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def everything(store):
    return [rows(t) for t in (store.articles, store.sources, store.categories, store.links)]


def stats(module, store):
    articles = store if module is rollup else store.articles
    tables_ = (module.totals(store), module.by_source(store), module.by_category(store), module.by_day(articles, DAY))
    return [[tuple(r) for r in t.collect()] for t in tables_]


def filled(spark, runs=3):
    path = scratch_dir(spark, "store")
    for run in range(runs):
        ingest(
            path,
            batch(
                spark,
                *[
                    article(i, f"https://a.com/{run + i}", f"T{run}", f"S{i % 2}", datetime(2024, 1, 28 + i % 3), ["x", f"c{i}"])
                    for i in range(6)
                ],
                article(9, f"https://a.com/u{run}", "undated", date=None, categories=["x"]),
            ),
            f"2024-01-3{run % 2} 0{run}:00:00",
        )
    return path


def test_compaction_keeps_rows_and_leaves_fewer_files(spark):
    path = filled(spark)
    before, counted = everything(tables.read_store(spark, path)), stats(rollup, tables.read_store(spark, path))
    files = {t: files_by_day(spark, path, t) for t in upkeep.ORDER}
    assert max(files["articles"].values()) > 1
    compact_store(spark, path)
    store = tables.read_store(spark, path)
    assert everything(store) == before
    assert stats(rollup, store) == counted == stats(statistics, store)
    for table, days in files.items():
        after = files_by_day(spark, path, table)
        assert set(after) == set(days) and set(after.values()) == {1}
    assert tables.read_table(spark, path, "sources").count() == store.sources.count()
    keys = tables.read_table(spark, path, "article_keys")
    assert keys.filter("bucket < 0").isEmpty() and keys.count() == store.articles.count()
    # Days with one file are left alone; further runs go on from there.
    compact_store(spark, path)
    again = ingest(path, batch(spark, article(0, "https://a.com/1"), article(1, "https://a.com/new")), DAY)
    assert counters(again) == {"processed": 2, "inserted": 1, "rejected": 0, "duplicates": 1}
    assert stats(rollup, tables.read_store(spark, path)) == stats(statistics, tables.read_store(spark, path))


def test_a_small_batch_reads_its_buckets_only(spark):
    path = filled(spark)
    compact_store(spark, path)
    store = tables.read_store(spark, path)
    urls = spark.createDataFrame([("https://a.com/1",), ("https://a.com/none",)], "url string")
    plan = tables.in_buckets(store.keys, urls)._jdf.queryExecution().executedPlan().toString()
    (found,) = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(re.findall(r"bucket#\d+ IN \(([^)]*)\)", found)[0].split(",")) == 3
    buckets = {r.bucket for r in tables.in_buckets(store.keys, urls).collect()}
    assert len(buckets) <= 2 and "bucket" in found


def test_lookups_read_days_from_the_index(spark):
    path = filled(spark)
    compact_store(spark, path)
    store = tables.read_store(spark, path)
    urls = spark.createDataFrame([("https://a.com/1",), ("https://a.com/u1",)], "url string")
    assert sorted(r.url for r in retrieval.articles_by_urls(store, urls).collect()) == ["https://a.com/1", "https://a.com/u1"]
    found = retrieval.article_by_url(store, "https://a.com/1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*date_day#\d+ = 2024-01-29", plan)
    assert found.first().url == "https://a.com/1"
    assert retrieval.article_by_url(store, "https://a.com/none").isEmpty()


def test_statistics_from_counts_read_no_article(spark):
    path = filled(spark)
    store = tables.read_store(spark, path)
    assert stats(rollup, store) == stats(statistics, store)
    for table in (rollup.totals(store), rollup.by_source(store), rollup.by_category(store), rollup.by_day(store, DAY)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "/articles]" not in plan and "/article_categories]" not in plan


@pytest.mark.parametrize("table", ["sources", "article_counts", "article_keys", "articles"])
def test_an_ingest_that_breaks_off_is_settled(spark, monkeypatch, table):
    """Whatever was written before the failure, a rerun leaves each row once, and counts equal scans."""
    path = filled(spark, 1)
    more = [article(i, f"https://a.com/more{i}", categories=["x", "new"]) for i in range(4)]

    def failing(name, *rest):
        if name == table:
            raise OSError("lost")
        tables.append(name, *rest)

    with monkeypatch.context() as patch:
        patch.setattr(ingest_module, "append", failing)
        with pytest.raises(OSError):
            ingest(path, batch(spark, *more), DAY)
    assert journal.pending(spark, path)
    # Readers do not see keys and counts of a run that has not ended.
    store = tables.read_store(spark, path)
    assert stats(rollup, store)[0][0][0] == 7 and store.keys.filter("url like '%more%'").isEmpty()
    assert counters(ingest(path, batch(spark, *more), DAY))["inserted"] == 4
    assert not journal.pending(spark, path)
    store = tables.read_store(spark, path)
    assert store.articles.count() == 11 and store.keys.count() == 11
    assert stats(rollup, store) == stats(statistics, store)


@pytest.mark.parametrize("there", [0, 2, 4])
def test_articles_of_a_broken_commit_keep_their_keys(spark, monkeypatch, there):
    """The run broke off while its articles were moved into place: those that are there are known."""
    path = filled(spark, 1)
    more = batch(spark, *[article(i, f"https://a.com/more{i}", categories=["x"]) for i in range(4)])

    def partly(name, df, where, run=None):
        if name == "articles":
            tables.append(name, df.orderBy("url").limit(there), where, run)
            raise OSError("lost")
        tables.append(name, df, where, run)

    with monkeypatch.context() as patch:
        patch.setattr(ingest_module, "append", partly)
        with pytest.raises(OSError):
            ingest(path, more, DAY)
    recover(spark, path)
    store = tables.read_store(spark, path)
    assert store.keys.filter("url like '%more%'").count() == there
    assert stats(rollup, store)[0][0][0] == 7 + there
    assert counters(ingest(path, more, DAY)) == {"processed": 4, "inserted": 4 - there, "rejected": 0, "duplicates": there}
    store = tables.read_store(spark, path)
    assert store.articles.count() == 11 == store.keys.count()
    assert stats(rollup, store)[:2] == stats(statistics, store)[:2]


def test_a_compaction_that_breaks_off_is_completed(spark, monkeypatch):
    path = filled(spark)
    before = everything(tables.read_store(spark, path))

    def removed(spark_, path_, table, copy):
        """The old files of the days are gone, the new ones are not there yet."""
        for row in spark.read.parquet(copy).select("date_day").distinct().collect():
            journal.remove(spark, f"{path}/{table}/date_day={row.date_day}")
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(upkeep, "_overwrite", removed)
        with pytest.raises(OSError):
            compact_store(spark, path)
    assert tables.read_table(spark, path, "articles").count() < len(before[0])
    recover(spark, path)
    recover(spark, path)
    assert everything(tables.read_store(spark, path)) == before


def test_a_store_without_an_index_gets_one(spark):
    path = filled(spark)
    for table in tables.DERIVED:
        journal.remove(spark, f"{path}/{table}")
    store = tables.read_store(spark, path)
    assert store.keys is None and retrieval.article_by_url(store, "https://a.com/1").count() == 1
    repeated = ingest(path, batch(spark, article(0, "https://a.com/1")), DAY)
    assert counters(repeated) == {"processed": 1, "inserted": 0, "rejected": 0, "duplicates": 1}
    store = tables.read_store(spark, path)
    assert store.keys.count() == store.articles.count()
    assert stats(rollup, store) == stats(statistics, store)


def test_counters_are_observed_on_the_writes(spark):
    """The counters are numbers already: no plan reads the batch again for them."""
    path = scratch_dir(spark, "store")
    staged = written(batch(spark, article(0, "https://a.com/1"), article(1, None), article(2, "https://a.com/1")), "rows")
    result = ingest(path, staged, DAY)
    plan = result.counters._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Aggregate" not in plan
    assert counters(result) == {"processed": 3, "inserted": 1, "rejected": 1, "duplicates": 1}
    empty = ingest(path, staged.filter(F.lit(False)), DAY)
    assert counters(empty) == {"processed": 0, "inserted": 0, "rejected": 0, "duplicates": 0}


def test_new_rows_are_marked_by_bitmaps(spark):
    """The rows asked for and no other, over several bitmaps a partition and ids of high bits; texts are not shuffled."""
    from pyspark.sql import functions as F

    from newsloom.plans.ingest import _marked
    from newsloom.session import written

    rows = spark.range(0, 200_000, 1, 3).selectExpr("id", "'text ' || id as content")
    staged = written(rows.withColumn("_row", F.monotonically_increasing_id()), "batch")
    winners = staged.filter("id % 3 = 0 or id < 10").selectExpr("_row", "id % 9 = 0 as clash")
    marked = _marked(staged, winners)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.content, r.clash) for r in marked.collect()}
    assert got == {i: (f"text {i}", i % 9 == 0) for i in range(200_000) if i % 3 == 0 or i < 10}
    final = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in final and "Exchange hashpartitioning" not in final, plan
    assert _marked(staged, winners.filter("false")).count() == 0
