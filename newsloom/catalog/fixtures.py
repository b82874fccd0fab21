"""Store-shaped views of the given tables, in Spark and as DuckDB text.

Two stores: orders (many small articles, a large link table) and documents
(articles with texts). Both sides derive every row of their tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.tables import StoreTables, surrogate_key

ORDERS_AS_OF = "2001-08-01 09:00:00"
DOCS_AS_OF = "2024-01-31 09:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- orders store -----------------------------------------------------------

SQL_SOURCES = """
select c_custkey as id, c_name as name,
       'https://feeds.example.com/' || cast(c_custkey as varchar) as url
from customer
"""
SQL_ARTICLES = """
select o_orderkey as id, 'Order ' || cast(o_orderkey as varchar) as title,
       'https://example.com/o/' || cast(o_orderkey as varchar) as url,
       o_custkey as source_id, o_orderdate as date,
       nullif(o_orderpriority, '4-NOT SPECIFIED') as summary
from orders
"""
SQL_LINKS = """
select distinct l_orderkey as article_id, p_type as category
from lineitem join part on l_partkey = p_partkey
"""
SQL_CATEGORIES = "select distinct p_type as name from part union all select 'UNUSED' as name"

SQL_ORDERS_STORE = f"""
with fx_sources as ({SQL_SOURCES}),
fx_articles as ({SQL_ARTICLES}),
fx_links as ({SQL_LINKS}),
fx_categories as ({SQL_CATEGORIES}),
fx_lists as (
  select article_id, string_agg(category, ',' order by category) as categories
  from fx_links group by article_id)
"""


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://feeds.example.com/"), F.col("c_custkey").cast("string")).alias("url"),
    )


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.concat(F.lit("https://example.com/o/"), key).alias("url"),
        F.col("o_custkey").alias("source_id"),
        F.col("o_orderdate").alias("date"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("summary"),
    )


def order_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    unused = spark.range(1).select(F.lit("UNUSED").alias("name"))
    return used.union(unused).select(surrogate_key(F.col("name")).alias("id"), "name")


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), surrogate_key(F.col("p_type")).alias("category_id")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", F.col("l_orderkey").alias("article_id"))
        .join(parts, "l_partkey")
        .select("article_id", "category_id")
        .distinct()
    )


def orders_store(spark: SparkSession, sf_dir: str) -> StoreTables:
    return StoreTables(
        articles=order_articles(spark, sf_dir),
        sources=order_sources(spark, sf_dir),
        categories=order_categories(spark, sf_dir),
        links=order_links(spark, sf_dir),
    )


# -- documents store --------------------------------------------------------

# The first line of a text is the summary, the second the description, and the
# dates spread over 45 days.
SQL_DOCS = """
select doc_id as id, 'Document ' || cast(doc_id as varchar) || ' (' || lang || ')' as title,
       'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url,
       source as source_name, 'https://' || source || '.example.com/feed' as source_url, lang,
       timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)) as date,
       nullif(split_part(text, chr(10), 1), '') as summary,
       nullif(split_part(text, chr(10), 2), '') as description,
       text as content
from documents
"""
SQL_DOCS_PAGE = f"""
with fx_docs as ({SQL_DOCS}),
fx_page as (
  select * from fx_docs where date >= timestamp '2024-01-24 00:00:00')
"""
SQL_REPORT_PAGE = f"""
with fx_docs as ({SQL_DOCS}),
fx_page as (
  select * from fx_docs where date >= timestamp '2024-01-01 00:00:00')
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    site = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))

    def line(number: int):
        return F.nullif(F.split_part("text", F.lit("\n"), F.lit(number)), F.lit(""))

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Document "), key, F.lit(" ("), F.col("lang"), F.lit(")")).alias("title"),
        F.concat(site, F.lit("/d/"), key).alias("url"),
        F.col("source").alias("source_name"),
        F.concat(site, F.lit("/feed")).alias("source_url"),
        "lang",
        F.expr(
            "timestampadd(DAY, -cast(doc_id % 45 as int), timestamp_ntz'2024-01-31 00:00:00')"
        ).alias("date"),
        line(1).alias("summary"),
        line(2).alias("description"),
        F.col("text").alias("content"),
    )


def docs_store(spark: SparkSession, sf_dir: str) -> StoreTables:
    rows = docs(spark, sf_dir)
    source_id = surrogate_key(F.col("source_name"))
    language = surrogate_key(F.col("lang"))
    sources = rows.select(
        source_id.alias("id"), F.col("source_name").alias("name"), F.col("source_url").alias("url")
    ).distinct()
    return StoreTables(
        articles=rows.withColumn("source_id", source_id).drop("source_name", "source_url", "lang"),
        sources=sources,
        categories=rows.select(language.alias("id"), F.col("lang").alias("name")).distinct(),
        links=rows.select(F.col("id").alias("article_id"), language.alias("category_id")),
    )


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw articles: text dates, a category list, markup-free texts."""
    return docs(spark, sf_dir).select(
        "title",
        "url",
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.lit("2024-01-31T09:00:00").alias("scraped_at"),
        F.col("source_name").alias("source"),
        "summary",
        "description",
        "content",
        F.array("lang", "source_name").alias("categories"),
    )


# -- dates and events -------------------------------------------------------

# Date texts in every accepted form, plus invalid and missing ones.
SQL_DATES = """
select event_id, case event_id % 8
  when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S')
  when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when 2 then strftime(ts, '%Y-%m-%d')
  when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
  when 4 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
  when 5 then strftime(ts, '%a, %d %b %Y %H:%M:%S +0200')
  when 6 then 'invalid-date' end as raw
from events
"""
SQL_PARSED = f"""
select event_id, raw, coalesce(
    try_strptime(regexp_replace(raw, 'Z$', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') at time zone 'UTC',
    try_strptime(raw, '%Y-%m-%dT%H:%M:%S'),
    try_strptime(raw, '%Y-%m-%d %H:%M:%S'),
    try_strptime(raw, '%a, %d %b %Y %H:%M:%S %z') at time zone 'UTC',
    try_strptime(raw, '%Y-%m-%d')) as date
from ({SQL_DATES})
"""


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """case event_id % 8
             when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
             when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss')
             when 2 then date_format(ts, 'yyyy-MM-dd')
             when 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
             when 4 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
             when 5 then date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0200'")
             when 6 then 'invalid-date' end as raw""",
    )


def event_articles(events: DataFrame, *more: Column) -> DataFrame:
    key = F.col("event_id").cast("string")
    return events.select(
        F.concat(F.lit("Event "), key).alias("title"),
        F.concat(F.lit("https://events.example.com/e/"), key).alias("url"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("date"),
        *more,
    )
