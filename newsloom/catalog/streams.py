"""Streams over the events table, run to their end and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from newsloom.catalog.fixtures import DOCS_AS_OF, event_articles, table
from newsloom.catalog.registry import query
from newsloom.operators.tables import read_store
from newsloom.session import scratch_dir
from newsloom.streaming import daily_counts, dedup_by_url, stream_into_store


FILES = 4
# A few events claim a date far in the future.
SQL_WRONG_DATE = "case when event_id % 97 = 5 then {later} else ts end"
SQL_STREAMED = f"""
select 'Event ' || cast(event_id as varchar) as title,
       'https://events.example.com/e/' || cast(event_id as varchar) as url, event_type as source,
       {SQL_WRONG_DATE.format(later="ts + interval 75 year")} as date
from events
"""


def stream_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of articles: several files, read one by one, each with dates of
    the whole time, so most articles are older than ones that came before."""
    events = table(spark, sf_dir, "events")
    path = scratch_dir(spark, "events")
    dated = events.withColumn("ts", F.expr(SQL_WRONG_DATE.format(later="ts + interval 75 year")))
    parts = dated.withColumn("part", (F.col("event_id") % FILES).cast("int"))
    parts.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(path)
    schema = StructType([*dated.schema.fields, StructField("part", IntegerType())])
    # As many files a batch as there are files of a part on average.
    n_files = len(spark.read.schema(schema).parquet(path).inputFiles())
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-n_files // FILES)).parquet(path)
    arrival = F.expr("timestamp'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, part, 0, 0)")
    return event_articles(rows, arrival.alias("scraped_at"))


def finished(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run ``stream`` to the end of its input; the rows it put out."""
    path = scratch_dir(spark, "stream")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    running = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{path}/out")


@query(
    f"""select case when event_id % 50 = 3 then null else title end as title, url, source, date,
      case when event_id % 50 = 3 then 'title missing' end as rejected
    from ({SQL_STREAMED.replace("from events", ", event_id from events")})"""
)
def stream_ingest(spark, sf_dir):
    """The store after two full runs of the stream, and the rejects of the first: the second
    run adds nothing to the store."""
    path = scratch_dir(spark, "store")
    number = F.substring_index("url", "/", -1).cast("long")
    articles = stream_articles(spark, sf_dir).withColumns(
        {
            "title": F.when(number % 50 != 3, F.col("title")),
            "categories": F.array("source"),
            **{
                name: F.lit(None).cast(StringType())
                for name in ("author", "summary", "description", "content", "image_url")
            },
        }
    )
    streams = []
    for _ in range(2):
        running = stream_into_store(articles, path, scratch_dir(spark, "checkpoint"), DOCS_AS_OF)
        running.awaitTermination()
        streams.append(str(running.id))
    rejects = spark.read.parquet(f"{path}/rejects").filter(F.col("title").isNull() & (F.col("stream") == streams[0]))
    store = read_store(spark, path)
    names = store.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    date = F.col("date").cast("timestamp_ntz").alias("date")
    stored = store.articles.join(names, "source_id").select(
        "title", "url", "source", date, F.lit(None).cast("string").alias("rejected")
    )
    return stored.unionByName(rejects.select("title", "url", "source", date, F.col("reason").alias("rejected")))


@query(SQL_STREAMED)
def stream_dedup(spark, sf_dir):
    """Every event arrives twice; one row per URL comes out."""
    articles = stream_articles(spark, sf_dir)
    deduplicated = dedup_by_url(articles.union(stream_articles(spark, sf_dir)))
    rows = finished(deduplicated, spark)
    return rows.select("title", "url", "source", F.col("date").cast("timestamp_ntz").alias("date"))


@query(f"select cast(date as date) as day, source, count(*) as n from ({SQL_STREAMED}) group by 1, 2")
def stream_daily(spark, sf_dir):
    """Counts as updated by the stream; the last update of a day counts."""
    updates = finished(daily_counts(stream_articles(spark, sf_dir)), spark, "update")
    return updates.groupBy("day", "source").agg(F.max_by("n", "batch").alias("n"))
