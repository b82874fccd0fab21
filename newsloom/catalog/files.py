"""Readers and writers, as round trips of the given tables."""

from pyspark.sql import functions as F

from newsloom.catalog.fixtures import raw_docs, table
from newsloom.catalog.registry import query
from newsloom.functions import parse_date
from newsloom.operators.normalize import normalize_articles
from newsloom.schemas import RAW_JSON
from newsloom.session import scratch_dir, written
from newsloom.sources import feeds, files

SQL_RAW = """
select 'Document ' || cast(doc_id as varchar) || ' (' || lang || ')' as title,
  'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url,
  strftime(timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)), '%Y-%m-%dT%H:%M:%S') as date,
  source, nullif(split_part(text, chr(10), 1), '') as summary, text as content, lang || ',' || source as categories
from documents
"""


def landed(spark, sf_dir) -> str:
    """Documents as JSON lines, one folder per source, and normalised articles beside them."""
    path = scratch_dir(spark, "outputs")
    files.write_by_source(raw_docs(spark, sf_dir), path)
    normal = normalize_articles(raw_docs(spark, sf_dir)).withColumn("source", F.lit("normalised, not landed"))
    files.write_articles(normal, f"{path}/{files.NORMALIZED_FILE}")
    return path


DOCS_A_FILE = 1000


def landed_arrays(spark, sf_dir) -> str:
    """Documents as a scraper writes them: files of one JSON array each, and one normalised file."""
    path = scratch_dir(spark, "arrays")
    keyed = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("key"),
        (F.col("doc_id") / DOCS_A_FILE).cast("long").alias("part"),
        "doc_id",
    )
    raw = raw_docs(spark, sf_dir).withColumn("key", F.regexp_extract("url", r"(/d/\d+)$", 1)).join(keyed, "key")
    item = F.struct("doc_id", *[name for name in raw.columns if name in RAW_JSON.fieldNames()])
    # At most DOCS_A_FILE documents are one file.
    grouped = raw.groupBy(F.col("source").alias("slug"), "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    texts = grouped.select(F.to_json("items", {"pretty": "true"}).alias("value"), "slug", "part")
    texts.write.partitionBy("slug", "part").text(path)
    normal = texts.limit(1).select("value")
    normal.write.text(f"{path}/slug=normal/{files.NORMALIZED_FILE}")
    return path


def edge(articles):
    return articles.select(
        "title", "url", "date", "source", "summary", "content", F.array_join("categories", ",").alias("categories")
    )


@query(SQL_RAW)
def scan_raw_json(spark, sf_dir):
    return edge(files.read_articles(spark, landed_arrays(spark, sf_dir)))


@query(SQL_RAW)
def scan_json_lines(spark, sf_dir):
    """The normalised articles in the folder are left out."""
    return edge(files.read_articles(spark, landed(spark, sf_dir), json_lines=True))


@query(
    f"""select 'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url,
    row_number() over (partition by source, doc_id // {DOCS_A_FILE} order by doc_id) - 1 as place from documents"""
)
def scan_places(spark, sf_dir):
    """The place of each article in its file."""
    rows = files.read_articles(spark, landed_arrays(spark, sf_dir), with_place=True)
    return rows.select("url", F.col("seq.row").alias("place"))


@query(SQL_RAW)
def write_by_source(spark, sf_dir):
    """The second write replaces French documents' sources only; nothing doubles."""
    path = landed(spark, sf_dir)
    raw = raw_docs(spark, sf_dir)
    # Written, so that Spark knows its size: planned unknown, the join would shuffle every text.
    french = written(raw.filter(F.array_contains("categories", "fr")).select("source").distinct(), "french")
    files.write_by_source(raw.join(french, "source", "left_semi"), path)
    return edge(files.read_articles(spark, path, json_lines=True))


@query("select source as stem, count(*) as n from documents group by 1")
def tag_source(spark, sf_dir):
    rows = files.read_articles(spark, landed(spark, sf_dir), json_lines=True, tag="source")
    return rows.groupBy(F.col("source").alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select upper(source[1]) || source[2:] as source_name, count(*) as n,
    max(strftime(timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)), '%Y-%m-%dT%H:%M:%S'))
      as newest from documents group by 1"""
)
def scan_titled_source(spark, sf_dir):
    rows = files.read_articles(spark, landed(spark, sf_dir), json_lines=True, tag="source_name")
    return rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("newest"))


@query(f"select url, date from ({SQL_RAW})")
def scan_sorted(spark, sf_dir):
    rows = files.read_articles(spark, landed(spark, sf_dir), json_lines=True)
    return files.newest_first(rows.select("url", "date"))


@query(
    """select 'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url, source, text as content,
      cast(null as varchar) as image_url from documents
    union all select url, cast(null as varchar), html, url from pages"""
)
def union_batches(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", F.col("html").alias("content"), F.col("url").alias("image_url"))
    return files.union_batches(raw_docs(spark, sf_dir).select("url", "source", "content"), pages)


@query(
    """select 'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url, source,
    timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)) as date,
    case when lang < source then lang || ',' || source else source || ',' || lang end as categories
    from documents"""
)
def write_normalized(spark, sf_dir):
    path = scratch_dir(spark, "normalized")
    files.write_articles(normalize_articles(raw_docs(spark, sf_dir)), path)
    back = files.read_articles(spark, path, json_lines=True)
    return back.select(
        "url",
        "source",
        F.col("date").cast("timestamp").cast("timestamp_ntz").alias("date"),
        F.array_join("categories", ",").alias("categories"),
    )


@query(
    """select s_name as name, 'https://feeds.example.com/' || cast(s_suppkey as varchar) as url,
    row_number() over (partition by s_nationkey order by s_suppkey) - 1 as place from supplier"""
)
def scan_feed_list(spark, sf_dir):
    """Lists of feeds, one for each nation, with the place of a feed in its list."""
    path = scratch_dir(spark, "feeds")
    feed = F.struct(
        "s_suppkey",
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://feeds.example.com/"), F.col("s_suppkey").cast("string")).alias("url"),
    )
    lists = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(feed)).alias("feeds"))
    lists.select(F.to_json("feeds").alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(path)
    return feeds.read_feed_list(spark, path).select("name", "url", F.col("seq.row").alias("place"))


# A third of the entries each: the link as such, as a permanent id, or beside an id that is no page. Two authors of
# every second one. Dates with zone names.
SQL_ENTRY = """
select 'Document ' || cast(doc_id as varchar) || ' (' || lang || ')' as title,
  'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as link,
  nullif(split_part(text, chr(10), 1), '') as summary, {content} as content,
  case when doc_id % 2 = 0 then source || ', ' || lang else source end as author,
  lang || ',' || source as categories,
  timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)) {shift} as published
from documents
"""


def entry_edge(entries):
    date = parse_date(F.col("published")).cast("timestamp_ntz")
    categories = F.array_join("categories", ",").alias("categories")
    return entries.select("title", "link", "summary", "content", "author", categories, date.alias("published"))


RSS_ROOT = (
    'channel xmlns:content="http://purl.org/rss/1.0/modules/content/" '
    'xmlns:dc="http://purl.org/dc/elements/1.1/"'
)


def _entry_parts(spark, sf_dir):
    """Documents with what the entries differ in."""
    doc_id = F.regexp_extract("url", r"/d/(\d+)$", 1).cast("long")
    authors = F.when(doc_id % 2 == 0, F.array("source", F.get("categories", F.lit(0)))).otherwise(F.array("source"))
    part = (doc_id / DOCS_A_FILE).cast("long")
    return raw_docs(spark, sf_dir).withColumns({"third": doc_id % 3, "authors": authors, "part": part})


@query(SQL_ENTRY.format(content="text", shift="+ case when doc_id % 3 = 0 then interval 5 hour else interval 0 hour end"))
def read_feed_xml(spark, sf_dir):
    path = scratch_dir(spark, "rss")
    third, moment = F.col("third"), F.col("date").cast("timestamp")
    other = F.concat(F.lit("id of "), F.col("title"))
    guid = F.struct(
        F.when(third == 1, F.col("url")).otherwise(other).alias("_VALUE"),
        F.when(third == 2, F.lit("false")).alias("_isPermaLink"),
    )
    _entry_parts(spark, sf_dir).select(
        "title",
        F.when(third != 1, F.col("url")).alias("link"),
        F.when(third > 0, guid).alias("guid"),
        F.col("summary").alias("description"),
        F.col("content").alias("content:encoded"),
        F.col("authors").alias("dc:creator"),
        F.col("categories").alias("category"),
        F.when(third == 0, F.concat(F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" EST"))).alias("pubDate"),
        F.when(third > 0, F.concat("date", F.lit("Z"))).alias("dc:date"),
    ).write.format("xml").option("rowTag", "item").option("rootTag", RSS_ROOT).option(
        "validateName", False
    ).save(path)
    return entry_edge(feeds.rss_entries(feeds.read_rss(spark, path)))


SQL_MARKUP = (
    "'<div xmlns=\"http://www.w3.org/1999/xhtml\"><p>' || source || ' <b>' || lang || '</b></p></div>'"
)


@query(SQL_ENTRY.format(content=f"case when doc_id % 3 = 0 then {SQL_MARKUP} else text end", shift=""))
def read_feed_atom(spark, sf_dir):
    """Feeds as XML texts, one for each source and part of the documents; a third of the entries with content that is
    XHTML."""
    path = scratch_dir(spark, "atom")

    def escaped(text):
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return text

    def element(name, text, attributes=""):
        return F.when(text.isNotNull(), F.concat(F.lit(f"<{name}{attributes}>"), text, F.lit(f"</{name}>"))).otherwise("")

    def link(url, kind):
        return F.concat(F.lit(f'<link rel="{kind}" href="'), url, F.lit('"/>'))

    third, lang = F.col("third"), F.get("categories", F.lit(0))
    xhtml = F.concat(
        F.lit('<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>'), F.col("source"), F.lit(" <b>"), lang,
        F.lit("</b></p></div></content>"),
    )
    entry = F.concat(
        F.lit("<entry>"),
        element("title", escaped(F.col("title"))),
        link(F.lit("https://example.com/self"), "self"),
        F.when(third == 1, element("id", F.col("url"))).otherwise(link(F.col("url"), "alternate")),
        element("summary", escaped(F.col("summary"))),
        F.when(third == 0, xhtml).otherwise(element("content", escaped(F.col("content")), ' type="html"')),
        F.array_join(F.transform("authors", lambda name: element("author", element("name", escaped(name)))), ""),
        F.array_join(F.transform("categories", lambda term: F.concat(F.lit('<category term="'), escaped(term), F.lit('"/>'))), ""),
        element("published", F.concat("date", F.lit("Z"))),
        F.lit("</entry>"),
    )
    # At most DOCS_A_FILE documents are one feed.
    entries = _entry_parts(spark, sf_dir).select(F.col("source").alias("slug"), "part", entry.alias("entry"))
    listed = entries.groupBy("slug", "part").agg(F.array_join(F.collect_list("entry"), "\n").alias("entries"))
    feed = F.concat(F.lit("<feed>\n"), "entries", F.lit("\n</feed>")).alias("value")
    listed.select(feed, "slug", "part").write.partitionBy("slug", "part").text(path)
    return entry_edge(feeds.atom_entries(feeds.read_atom(spark, path)))
