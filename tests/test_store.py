"""Ingest, upserts and lookups on a small store, against plain Python."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from newsloom.operators import tables
from newsloom.operators.dedup import absent_from, first_wins
from newsloom.operators.match import match_feeds
from newsloom.operators.summary import with_model_summary
from newsloom.plans import retrieval, statistics
from newsloom.plans.ingest import ingest
from newsloom.session import scratch_dir

SCHEMA = (
    "title string, url string, source string, date timestamp, author string, summary string, description string, "
    "content string, categories array<string>, image_url string, scraped_at timestamp, seq long"
)


def article(seq, url, title="T", source="S", date=datetime(2024, 1, 30), categories=()):
    return (title, url, source, date, None, None, None, "text", list(categories), None, None, seq)


def batch(spark, *articles):
    return spark.createDataFrame(list(articles), SCHEMA)


def counters(result):
    return result.counters.first().asDict()


def test_ingest_twice(spark):
    path = scratch_dir(spark, "store")
    rows = batch(
        spark,
        article(0, "https://a.com/1", "first", "A", categories=["x", "y"]),
        article(1, "https://a.com/1", "second", "B", categories=["z"]),
        article(2, "https://a.com/2", "undated", "B", date=None, categories=["x"]),
        article(3, None, "no url"),
        article(4, "https://a.com/4", None),
    )
    feeds = spark.createDataFrame([(0, "a!", "https://feed/a"), (1, "A", "https://feed/other")], "seq long, name string, url string")
    result = ingest(path, rows, "2024-01-31 09:00:00", feeds)
    assert counters(result) == {"processed": 5, "inserted": 2, "rejected": 2, "duplicates": 1}
    assert {r.reason for r in result.rejects.collect()} == {"title missing", "url missing or malformed"}

    again = ingest(path, rows, "2024-02-07 09:00:00")
    assert counters(again) == {"processed": 5, "inserted": 0, "rejected": 2, "duplicates": 3}

    store = tables.read_store(spark, path)
    assert {(r.title, r.url) for r in store.articles.collect()} == {
        ("first", "https://a.com/1"), ("undated", "https://a.com/2"),
    }
    assert {r.name for r in store.categories.collect()} == {"x", "y"}
    assert store.links.count() == 3
    sources = {r.name: r for r in store.sources.collect()}
    assert set(sources) == {"A", "B", "S"}
    assert sources["A"].url == "https://feed/a"  # the second run had no feed list: the stored URL stays
    assert sources["A"].created_at == datetime(2024, 1, 31, 9)
    assert sources["A"].last_updated == datetime(2024, 2, 7, 9)

    found = retrieval.article_by_url(store, "https://a.com/1").first()
    assert (found.source_name, found.categories) == ("A", ["x", "y"])
    assert retrieval.article_by_url(store, "https://a.com/9").count() == 0
    recent = retrieval.recent_articles(store, "2024-01-31 09:00:00").collect()
    assert [r.title for r in recent] == ["first"]
    undated = retrieval.article_by_url(store, "https://a.com/2").first()
    assert (undated.date, undated.categories) == (None, ["x"])
    assert [r.title for r in retrieval.articles_by_category(store, "x").collect()] == ["first", "undated"]
    wanted = spark.createDataFrame([("https://a.com/2",), ("https://a.com/1",), ("https://a.com/7",)], "url string")
    found = {r.title: r.categories for r in retrieval.articles_by_urls(store, wanted).collect()}
    assert found == {"first": ["x", "y"], "undated": ["x"]}
    assert retrieval.articles_by_category(store, "x").first().categories == ["x"]
    assert retrieval.articles_by_category(store, "x", all_categories=True).first().categories == ["x", "y"]
    assert statistics.totals(store).first().asDict() == {
        "total_articles": 2, "total_sources": 3, "total_categories": 2,
    }
    assert [tuple(r) for r in statistics.by_source(store).collect()] == [("A", 1), ("B", 1), ("S", 0)]


def test_known_sources_only(spark):
    path = scratch_dir(spark, "store")
    feeds = spark.createDataFrame([(0, "A & B", "https://feed/ab")], "seq long, name string, url string")
    rows = batch(spark, article(0, "https://a.com/1", source="a-b"), article(1, "https://a.com/2", source="other"))
    result = ingest(path, rows, "2024-01-31", feeds, known_sources_only=True)
    assert counters(result) == {"processed": 2, "inserted": 1, "rejected": 1, "duplicates": 0}
    assert [r.reason for r in result.rejects.collect()] == ["source not in the feed list"]
    store = tables.read_store(spark, path)
    assert [(r.name, r.url) for r in store.sources.collect()] == [("a-b", "https://feed/ab")]


def test_interrupted_ingest_is_repaired(spark):
    """Links and categories without their article: a rerun adds each row once."""
    path = scratch_dir(spark, "store")
    rows = batch(spark, article(0, "https://a.com/1", categories=["x"]))
    tables.create_store(spark, path)
    key = spark.sql("select xxhash64('https://a.com/1') as article_id, xxhash64('x') as category_id, date'2024-01-30' as date_day")
    tables.append("article_categories", key, path)
    tables.append("categories", spark.sql("select xxhash64('x') as id, 'x' as name"), path)
    ingest(path, rows, "2024-01-31 09:00:00")
    store = tables.read_store(spark, path)
    assert (store.articles.count(), store.links.count(), store.categories.count()) == (1, 1, 1)


def test_key_clash_is_rejected_not_merged(spark, monkeypatch):
    from pyspark.sql import functions as F

    from newsloom.plans import ingest as module

    monkeypatch.setattr(module, "surrogate_key", lambda c: F.length(c).cast("long"))
    path = scratch_dir(spark, "store")
    first = ingest(path, batch(spark, article(0, "https://a.com/1"), article(1, "https://a.com/2")), "2024-01-31")
    assert counters(first) == {"processed": 2, "inserted": 1, "rejected": 1, "duplicates": 0}
    second = ingest(path, batch(spark, article(0, "https://a.com/3"), article(1, "https://a.com/1")), "2024-01-31")
    assert counters(second) == {"processed": 2, "inserted": 0, "rejected": 1, "duplicates": 1}
    assert [r.reason for r in second.rejects.collect()] == ["id taken by another url"]


def test_model_summaries_of_new_articles(spark):
    path = scratch_dir(spark, "store")
    rows = batch(spark, article(0, "https://a.com/1"), article(1, "https://a.com/2"))
    ingest(path, rows, "2024-01-31", summarize=with_model_summary(lambda: lambda texts: [t.upper() for t in texts]))
    assert {r.summary for r in tables.read_store(spark, path).articles.collect()} == {"TEXT"}


URLS = st.sampled_from([None, *[f"https://a.com/{i}" for i in range(6)]])
TITLES = st.sampled_from([None, "t1", "t2"])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(URLS, TITLES, st.sets(st.sampled_from("xyz"))), max_size=12), min_size=2, max_size=2))
def test_ingest_equals_a_row_by_row_insert(spark, runs):
    path = scratch_dir(spark, "store")
    expected, links = {}, set()
    for run in runs:
        rows = [article(i, url, title, categories=sorted(names)) for i, (url, title, names) in enumerate(run)]
        inserted = rejected = 0
        for url, title, names in run:
            if url is None or title is None:
                rejected += 1
            elif url not in expected:
                inserted += 1
                expected[url] = title
                links |= {(url, name) for name in names}
        got = counters(ingest(path, batch(spark, *rows), "2024-01-31 09:00:00"))
        assert got["processed"] == len(run) == got["inserted"] + got["duplicates"] + got["rejected"]
        assert (got["inserted"], got["rejected"]) == (inserted, rejected)
    store = tables.read_store(spark, path)
    assert {r.url: r.title for r in store.articles.collect()} == expected
    assert store.articles.count() == len(expected)
    lists = retrieval.category_lists(store).withColumnRenamed("article_id", "id").join(store.articles, "id")
    assert {(r.url, name) for r in lists.collect() for name in r.categories} == links


def test_first_wins_with_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as url", "id as seq", "'t' as scraped_at")
    kept = first_wins(rows)
    assert kept.count() == 2001
    assert kept.filter("url = 'hot'").first().seq == 0


def test_absent_from_two_keys(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "a int, b int")
    right = spark.createDataFrame([(1, 2), (9, 9)], "a int, b int")
    assert sorted(tuple(r) for r in absent_from(left, right, ["a", "b"]).collect()) == [(1, 1), (2, 1)]


def test_match_feeds(spark):
    sources = spark.createDataFrame([("ai-machine-learning",), ("src2",), ("other",)], "source string")
    feeds = spark.createDataFrame(
        [(0, "AI & Machine Learning", "u0"), (1, " Src2! ", "u1"), (2, "SRC2", "dup")], "seq long, name string, url string"
    )
    found = {r.source: (r.feed_url, r.matched) for r in match_feeds(sources, feeds).collect()}
    assert found == {"ai-machine-learning": ("u0", True), "src2": ("u1", True), "other": (None, False)}


def test_upsert_sources_keeps_id_and_creation(spark):
    stored = spark.sql(
        "select 7L as id, 'A' as name, 'old' as url, timestamp'2024-01-01' as last_updated, timestamp'2024-01-01' as created_at"
    )
    incoming = spark.createDataFrame([("A", "new"), ("B", "b")], "name string, url string")
    rows = {r.name: r for r in tables.upsert_sources(stored, incoming, "2024-01-31").collect()}
    assert (rows["A"].id, rows["A"].url, rows["A"].created_at) == (7, "new", datetime(2024, 1, 1))
    assert (rows["B"].url, rows["B"].created_at) == ("b", datetime(2024, 1, 31))


def test_create_store_twice_changes_nothing(spark):
    path = scratch_dir(spark, "store")
    tables.create_store(spark, path)
    ingest(path, batch(spark, article(0, "https://a.com/1")), "2024-01-31")
    tables.create_store(spark, path)
    assert tables.read_store(spark, path).articles.count() == 1


@pytest.mark.parametrize("exact, expected", [(False, {1, 2, 4}), (True, {1, 4})])
def test_recency_by_day_or_exact(spark, exact, expected):
    rows = spark.sql(
        "select * from values (1, timestamp'2024-01-24 09:00:00'), (2, timestamp'2024-01-24 00:00:00'), "
        "(3, timestamp'2024-01-23 23:59:59'), (4, timestamp'2030-01-01 00:00:00'), (5, null) as t(id, date)"
    )
    kept = retrieval.recent_window(rows, "2024-01-31 09:00:00", 7, exact)
    assert {r.id for r in kept.collect()} == expected
