"""The whole weekly run on the documents."""

from pyspark.sql import functions as F

from newsloom.catalog.digest import echo
from newsloom.catalog.files import RSS_ROOT
from newsloom.catalog.fixtures import DOCS_AS_OF, raw_docs
from newsloom.catalog.normalizing import SQL_SPACE
from newsloom.catalog.registry import query
from newsloom.operators.tables import read_store
from newsloom.plans.retrieval import category_lists
from newsloom.plans.weekly import ingest_landed, land_feeds, publish_week
from newsloom.session import scratch_dir
from newsloom.sources import read_rss, rss_entries


def sql_text(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '{SQL_SPACE}', ' ', 'g')), '')"


@query(
    f"""select 'Document ' || cast(doc_id as varchar) || ' (' || lang || ')' as title,
    'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url, source as source_name,
    timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)) as date,
    coalesce({sql_text("split_part(text, chr(10), 1)")}, '') as summary, coalesce({sql_text("text")}, '') as content,
    case when lang < source then lang || ',' || source else source || ',' || lang end as categories
    from documents
    where timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)) >= timestamp '2024-01-24 09:00:00'"""
)
def weekly_run(spark, sf_dir):
    """RSS documents are landed, ingested and published; the store afterwards."""
    work = scratch_dir(spark, "week")
    raw_docs(spark, sf_dir).select(
        "title",
        F.col("url").alias("link"),
        F.col("summary").alias("description"),
        F.col("content").alias("content:encoded"),
        F.col("source").alias("dc:creator"),
        F.col("categories").alias("category"),
        F.col("date").alias("pubDate"),
    ).write.format("xml").option("rowTag", "item").option("rootTag", RSS_ROOT).option(
        "validateName", False
    ).save(f"{work}/feeds")
    entries = rss_entries(read_rss(spark, f"{work}/feeds")).withColumn("source", F.col("author"))
    land_feeds(entries, f"{work}/outputs", DOCS_AS_OF)
    ingest_landed(spark, f"{work}/outputs", f"{work}/store", DOCS_AS_OF)
    publish_week(spark, f"{work}/store", f"{work}/out", DOCS_AS_OF, echo)
    store = read_store(spark, f"{work}/store")
    names = store.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    lists = category_lists(store).withColumnRenamed("article_id", "id")
    return (
        store.articles.join(names, "source_id")
        .join(lists, "id", "left")
        .select(
            "title",
            "url",
            "source_name",
            F.col("date").cast("timestamp_ntz").alias("date"),
            F.coalesce("summary", F.lit("")).alias("summary"),
            F.coalesce("content", F.lit("")).alias("content"),
            F.array_join("categories", ",").alias("categories"),
        )
    )
