"""Schemas of the raw input and of the four store tables."""

from pyspark.sql import types as T

# ``categories`` and ``content`` may be a string or a list in landed files, so
# they are read as JSON text and shaped by the reader.
RAW_JSON = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "title", "url", "date", "scraped_at", "source", "source_name",
            "summary", "description", "content", "content_encoded",
            "author", "categories", "image_url",
        )
    ]
)

FEED_LIST = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

RSS_ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content:encoded", T.StringType()),
        T.StructField("dc:creator", T.ArrayType(T.StringType())),
        T.StructField("author", T.ArrayType(T.StringType())),
        T.StructField("category", T.ArrayType(T.StringType())),
        T.StructField("pubDate", T.StringType()),
        T.StructField("dc:date", T.StringType()),
        T.StructField(
            "guid",
            T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_isPermaLink", T.StringType())]),
        ),
    ]
)

# An element read as text keeps the markup inside it: XHTML content is one text.
ATOM_ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField(
            "link",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("_href", T.StringType()),
                        T.StructField("_rel", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField(
            "category",
            T.ArrayType(T.StructType([T.StructField("_term", T.StringType())])),
        ),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# ``date_day`` is the partition column of the two large tables.
ARTICLE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("source_id", T.LongType(), False),
        T.StructField("date", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("scraped_at", T.TimestampType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("date_day", T.DateType()),
    ]
)

CATEGORY = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
    ]
)

LINK = T.StructType(
    [
        T.StructField("article_id", T.LongType(), False),
        T.StructField("category_id", T.LongType(), False),
        T.StructField("date_day", T.DateType()),
    ]
)

# The key index: found by id without reading an article. What a run adds is in bucket -1, until compaction
# sorts it into the buckets of the id.
KEY = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("date_day", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("run", T.StringType()),
    ]
)

# What each run added: articles by day and source (no category), links by day and category (no source).
COUNT = T.StructType(
    [
        T.StructField("date_day", T.DateType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("n", T.LongType(), False),
        T.StructField("run", T.StringType()),
    ]
)
