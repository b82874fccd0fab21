"""The physical plans that scale depends on."""

import re

import pytest

from newsloom.catalog.fixtures import DOCS_AS_OF, ORDERS_AS_OF, orders_store
from newsloom.catalog.store import twice
from newsloom.operators import tables
from newsloom.operators.dedup import insert_if_absent
from newsloom.operators.normalize import normalize_articles
from newsloom.plans import retrieval, statistics
from newsloom.plans.ingest import ingest
from newsloom.session import scratch_dir, written
from newsloom.catalog.fixtures import order_articles, raw_docs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    path = scratch_dir(spark, "store")
    ingest(path, normalize_articles(raw_docs(spark, sf_dir)), DOCS_AS_OF)
    return tables.read_store(spark, path)


def test_recent_articles(spark, sf_dir):
    text = plan(retrieval.recent_articles(orders_store(spark, sf_dir), ORDERS_AS_OF, limit=25))
    assert "TakeOrderedAndProject(limit=25" in text
    assert "GreaterThanOrEqual(o_orderdate,2001-07-25T00:00)" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_recent_articles_prune_days_and_texts(stored):
    text = plan(retrieval.recent_articles(stored, DOCS_AS_OF, limit=5))
    assert "date_day" in text
    assert re.search(r"PartitionFilters: \[isnotnull\(date_day#\d+\), \(date_day#\d+ >= 2024-01-24\)", text)
    assert "dynamicpruning" in text
    top = text[text.rindex("TakeOrderedAndProject"):]
    assert "content" not in top


def test_point_lookup_is_pushed_down(stored):
    text = plan(retrieval.article_by_url(stored, "https://src1.example.com/d/1"))
    assert "EqualTo(url,https://src1.example.com/d/1)" in text


def test_counts_aggregate_before_the_join(stored):
    text = plan(statistics.by_source(stored))
    assert text.index("Join") < text.index("partial_count")
    assert "content" not in text


def test_insert_limits_each_key_before_the_shuffle(spark, sf_dir):
    articles = order_articles(spark, sf_dir)
    text = plan(insert_if_absent(twice(articles), articles, "url", ("date", "seq")))
    before_shuffle = text[text.index("WindowGroupLimit"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_cleaning_stays_in_the_jvm(spark, sf_dir):
    text = plan(normalize_articles(raw_docs(spark, sf_dir)))
    assert "Python" not in text and "Exchange" not in text


def scans_with_content(text):
    return [line for line in text.split("\n") if "ReadSchema" in line and "content" in line]


def test_lookups_read_texts_of_matching_days_only(spark, stored):
    """A plain table of URLs, and a category: literal days reach the scans that read texts."""
    urls = spark.createDataFrame([("https://src1.example.com/d/1",)], "url string")
    for found in (retrieval.articles_by_urls(stored, urls), retrieval.articles_by_category(stored, "en", 2)):
        text = plan(found)
        assert re.search(r"PartitionFilters: \[[^\]]*date_day#\d+ (=|IN)", text) or re.search(
            r"PartitionFilters: \[.*date_day#\d+ = 20", text
        )
        assert found.count() > 0


def test_new_links_read_the_days_of_the_batch_only(spark, stored):
    pairs = stored.links.filter("date_day = '2024-01-30'")
    text = plan(tables.new_links(written(pairs, "pairs"), stored.links))
    assert re.search(r"PartitionFilters: \[[^\]]*date_day#\d+ = 2024-01-30", text)
