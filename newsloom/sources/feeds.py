"""Feed lists and landed RSS / Atom documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.schemas import ATOM_ENTRY, FEED_LIST, RSS_ITEM
from newsloom.sources.files import json_records


def read_feed_list(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Feeds as (seq, name, url), ``seq`` being the order in which they apply: by file name, then by the place in it."""
    feeds = json_records(spark, path, FEED_LIST, json_lines).filter("_corrupt_record is null and coalesce(name, url) is not null")
    return feeds.select(F.col("_place").alias("seq"), "name", "url")


def _read_xml(spark: SparkSession, path: str, tag: str, schema: StructType, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("xml")
        .option("rowTag", tag)
        .option("ignoreSurroundingSpaces", False)
        .schema(schema)
        .load(path)
    )


def read_rss(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The items of the RSS documents at ``path``; with ``stream``, of each new one."""
    return _read_xml(spark, path, "item", RSS_ITEM, stream)


def read_atom(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The entries of the Atom documents at ``path``; with ``stream``, of each new one."""
    return _read_xml(spark, path, "entry", ATOM_ENTRY, stream)


def _given(text: Column) -> Column:
    return F.nullif(F.btrim(text), F.lit(""))


def _joined(names: Column) -> Column:
    """All authors as one text."""
    return _given(F.array_join(F.filter(names, lambda name: F.btrim(name) != ""), ", "))


def rss_entries(items: DataFrame) -> DataFrame:
    """RSS items under the common entry names. Without a link the page is the ``guid``, unless that says that it
    is none; without ``pubDate`` the date is ``dc:date``. Several authors are one text."""
    permalink = F.when(F.lower(F.coalesce("guid._isPermaLink", F.lit("true"))) != "false", _given(F.col("guid._VALUE")))
    return items.select(
        "title",
        F.coalesce(_given(F.col("link")), permalink).alias("link"),
        F.col("description").alias("summary"),
        "description",
        F.col("`content:encoded`").alias("content"),
        F.coalesce(_joined(F.col("author")), _joined(F.col("`dc:creator`"))).alias("author"),
        F.col("category").alias("categories"),
        F.coalesce(_given(F.col("pubDate")), _given(F.col("`dc:date`"))).alias("published"),
    )


def atom_entries(entries: DataFrame) -> DataFrame:
    """Atom entries under the common entry names; the page is the 'alternate' link, else the ``id``. Content that is
    XHTML comes as its markup; several authors are one text."""
    page = F.filter("link", lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
    return entries.select(
        "title",
        F.coalesce(_given(F.get(page, F.lit(0))["_href"]), _given(F.col("id"))).alias("link"),
        "summary",
        F.col("summary").alias("description"),
        F.nullif("content", F.lit("")).alias("content"),
        _joined(F.col("author.name")).alias("author"),
        F.transform("category", lambda category: category["_term"]).alias("categories"),
        F.coalesce("published", "updated").alias("published"),
    )
