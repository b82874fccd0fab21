"""Articles: recent, by category, by URL. All of them put the top-N first."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.clock import day_start, days_before, instant_like
from newsloom.operators.tables import UNDATED_DAY, StoreTables, in_buckets, on_days
from newsloom.session import written


def newest_order() -> list[Column]:
    return [F.col("date").desc_nulls_last(), F.col("id").asc()]


def since(articles: DataFrame, start: datetime) -> DataFrame:
    """Articles dated ``start`` or later, reading only the days that can match."""
    rows = articles.filter(F.col("date") >= instant_like(articles, "date", start))
    if "date_day" in articles.columns:
        rows = rows.filter(F.col("date_day") >= F.lit(start.date()))
    return rows


def recent_window(articles: DataFrame, as_of: datetime | str, days: int, exact: bool = False) -> DataFrame:
    """Articles since the start of the day ``days`` days ago, or with ``exact``
    since that very moment. There is no upper bound; undated ones are out."""
    moment = days_before(as_of, days)
    return since(articles, moment if exact else day_start(moment))


def _key_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """``id``, and the day when both sides have it: joins on it prune days."""
    return [name for name in ("id", "date_day") if name in left.columns and name in right.columns]


def _keys(articles: DataFrame, *more: str) -> DataFrame:
    names = ["id", "date", "date_day", *more]
    return articles.select(*[name for name in names if name in articles.columns])


def _pick(articles: DataFrame, top: DataFrame) -> DataFrame:
    """The whole rows of the keys in ``top``. Spark derives the size of ``top``
    from its limit, and broadcasts it (pruning days with it) when that is small."""
    on = _key_columns(articles, top)
    return articles.join(top.select(*on), on, "left_semi")


def _top(articles: DataFrame, limit: int) -> DataFrame:
    return articles.orderBy(*newest_order()).limit(limit)


def category_lists(store: StoreTables, articles: DataFrame | None = None) -> DataFrame:
    """(article_id, categories): sorted names per article.

    ``articles`` restricts the work to these rows' links; Spark broadcasts
    their keys when they are small. Names are collected as a set, which
    collapses repeats before the shuffle: a list is never longer than the
    category table.
    """
    links = store.links.withColumnRenamed("article_id", "id")
    if articles is not None:
        on = _key_columns(links, articles)
        links = links.join(articles.select(*on), on, "left_semi")
    names = store.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (
        links.join(names, "category_id")
        .groupBy(F.col("id").alias("article_id"))
        .agg(F.array_sort(F.collect_set("category")).alias("categories"))
    )


def _with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select(
        F.col("id").alias("source_id"),
        F.col("name").alias("source_name"),
        F.col("url").alias("source_url"),
    )
    return articles.join(named, "source_id")


def _with_categories(articles: DataFrame, lists: DataFrame) -> DataFrame:
    lists = lists.withColumnRenamed("article_id", "id")
    joined = articles.join(lists, "id", "left")
    nothing = F.array().cast("array<string>")
    return joined.withColumn("categories", F.coalesce("categories", nothing))


def _text_not_null(articles: DataFrame) -> DataFrame:
    names = [name for name in ("summary", "content") if name in articles.columns]
    return articles.withColumns({name: F.coalesce(name, F.lit("")) for name in names})


def recent_articles(
    store: StoreTables, as_of: datetime | str, days: int = 7, limit: int = 10, exact: bool = False
) -> DataFrame:
    """The newest ``limit`` articles of the window, with source and categories.

    The newest keys are found on narrow columns. Texts, sources and categories
    are fetched for these rows only.
    """
    window = recent_window(store.articles, as_of, days, exact)
    stored_sources = store.sources.select(F.col("id").alias("source_id"))
    top = _top(_keys(window, "source_id").join(stored_sources, "source_id", "left_semi"), limit)
    rows = _with_source(_pick(window, top), store.sources)
    rows = _with_categories(rows, category_lists(store, top))
    return _text_not_null(rows).orderBy(*newest_order())


def window_articles(store: StoreTables, as_of: datetime | str, days: int = 7, exact: bool = False) -> DataFrame:
    """All articles of the window with their source, in no order. Only the columns that are used
    further on are read."""
    return _text_not_null(_with_source(recent_window(store.articles, as_of, days, exact), store.sources))


def articles_by_category(
    store: StoreTables, category: str, limit: int = 10, all_categories: bool = False
) -> DataFrame:
    """The newest ``limit`` articles of a category. ``categories`` holds just
    that one, unless ``all_categories`` asks for the whole list."""
    wanted = store.categories.filter(F.col("name") == category)
    links = store.links.join(wanted.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    links = links.withColumnRenamed("article_id", "id")
    on = _key_columns(store.articles, links)
    stored_sources = store.sources.select(F.col("id").alias("source_id"))

    def newest(articles: DataFrame, members: DataFrame) -> DataFrame:
        keys = _keys(articles, "source_id").join(members.select(*on), on, "left_semi")
        return _top(keys.join(stored_sources, "source_id", "left_semi"), limit)

    if "date_day" in on:
        top, store = _newest_by_days(store, links, newest, limit)
    else:
        top = newest(store.articles, links)
    rows = _with_source(_pick(store.articles, top), store.sources)
    if all_categories:
        rows = _with_categories(rows, category_lists(store, top))
    else:
        rows = rows.withColumn("categories", F.array(F.lit(category)))
    return rows.orderBy(*newest_order())


def _newest_by_days(
    store: StoreTables, links: DataFrame, newest: Callable[[DataFrame, DataFrame], DataFrame], limit: int
) -> tuple[DataFrame, StoreTables]:
    """The newest keys, and the store reduced to the days they are on.

    The links are counted by day, without any other column; then as many of the newest days are read as hold
    ``limit`` links, and more if articles without source left too few. The driver sees one count per
    day.
    """
    counts = {r.date_day: r["count"] for r in links.groupBy("date_day").count().collect()}
    undated = date.fromisoformat(UNDATED_DAY)
    days = sorted(counts, key=lambda day: (day == undated, -day.toordinal()))
    n_days = 0
    while True:
        held = sum(counts[day] for day in days[:n_days])
        while n_days < len(days) and held < limit:
            held += counts[days[n_days]]
            n_days += 1
        keys = store.articles.sparkSession.createDataFrame([(day,) for day in days[:n_days]], "date_day date")
        top = written(newest(on_days(store.articles, keys), on_days(links, keys)), "newest")
        found = top.count()
        if found >= limit or n_days == len(days):
            near = store._replace(articles=on_days(store.articles, top), links=on_days(store.links, top))
            return top, near
        # Twice as many days, at least one more.
        n_days = min(len(days), 2 * n_days + 1)


def article_by_url(store: StoreTables, url: str) -> DataFrame:
    """The article with this URL, or no row. With a key index only its day is read."""
    if store.keys is not None:
        wanted = store.articles.sparkSession.createDataFrame([(url,)], "url string")
        found = in_buckets(store.keys, wanted).filter(F.col("url") == url)
        store = store._replace(articles=on_days(store.articles, found), links=on_days(store.links, found))
    rows = store.articles.filter(F.col("url") == url)
    return _with_categories(_with_source(rows, store.sources), category_lists(store, _keys(rows)))


def articles_by_urls(store: StoreTables, urls: DataFrame) -> DataFrame:
    """The articles of a table of URLs. In a store partitioned by day, the keys are found first,
    in the key index, and written; texts and links are read from their days only."""
    wanted = urls.select("url").distinct()
    rows = store.articles.join(wanted, "url", "left_semi")
    if "date_day" not in rows.columns:
        return _with_categories(_with_source(rows, store.sources), category_lists(store, _keys(rows)))
    if store.keys is None:
        keys = written(_keys(rows), "keys")
    else:
        wanted = written(wanted, "urls")
        keys = in_buckets(store.keys, wanted).join(wanted, "url", "left_semi").select("id", "date_day")
        keys = written(keys.distinct(), "keys")
    near = store._replace(articles=on_days(store.articles, keys), links=on_days(store.links, keys))
    rows = _pick(near.articles, keys)
    return _with_categories(_with_source(rows, store.sources), category_lists(near, keys))


def all_categories(store: StoreTables) -> DataFrame:
    return store.categories.select("name").orderBy("name")
