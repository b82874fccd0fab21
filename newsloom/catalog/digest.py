"""Digest and report documents."""

from pyspark.sql import functions as F

from newsloom.catalog.fixtures import DOCS_AS_OF, SQL_DOCS_PAGE, SQL_REPORT_PAGE, docs_store, table
from newsloom.catalog.registry import query
from newsloom.plans import digest, report
from newsloom.plans.retrieval import window_articles
from newsloom.session import scratch_dir, written
from newsloom.sources import files

PERIOD = "24/01/2024 au 31/01/2024"


def week(spark, sf_dir):
    return window_articles(docs_store(spark, sf_dir), DOCS_AS_OF, days=7)


def stored_week(spark, sf_dir):
    """The week's articles as the weekly run has them: queried once, written."""
    return written(week(spark, sf_dir), "week")


def month(spark, sf_dir):
    return window_articles(docs_store(spark, sf_dir), DOCS_AS_OF, days=30)


SQL_BLOCKS = (
    SQL_DOCS_PAGE
    + """,
fx_blocks as (
  select source_name as source, id, date,
    chr(10) || '### [' || title || '](' || url || ') - ' || strftime(date, '%d/%m/%Y') ||
    case when length(summary) > 50 then chr(10) || 'Résumé : ' || summary
         when length(description) > 50 then chr(10) || 'Description : ' || description
         when length(content) > 2000 then chr(10) || 'Contenu : ' || content[1:2000] || '...'
         when length(content) > 50 then chr(10) || 'Contenu : ' || content
         else '' end as block
  from fx_page),
fx_sources as (
  select source, count(*) as n_articles, max(date) as newest,
    (array_agg(id order by date desc, id))[1] as first_id
  from fx_blocks group by source),
fx_ranked as (
  select *, row_number() over (partition by source order by date desc, id) - 1 as place from fx_blocks),
fx_bodies as (
  select source, cast(place // {slice} as integer) as slice, n_articles, newest, first_id,
    case when place // {slice} = 0 then
      chr(10) || '## Articles de ' || source || ' (' || cast(n_articles as varchar) || ' articles)' || chr(10)
      else '' end || string_agg(block, chr(10) order by date desc, id) as body
  from fx_ranked join fx_sources using (source)
  group by source, place // {slice}, n_articles, newest, first_id)
"""
)
SLICE = 5  # articles of a source in the sliced queries
REQUEST_START = f"""'Rédige la synthèse hebdomadaire, en français et en Markdown, des articles publiés du {PERIOD}.' ||
  chr(10) || chr(10)"""
REQUEST_END = """chr(10) || chr(10) ||
  'Commence par une synthèse de 400 à 500 mots des tendances importantes, puis ' ||
  'donne la liste des liens à lire pour approfondir.' || chr(10)"""
# The answers of the echo are the requests; a second request joins them.
SQL_DIGEST = (
    SQL_BLOCKS.replace("{slice}", str(digest.SLICE_ARTICLES))
    + f""",
fx_requests as (
  select newest, first_id, slice, {REQUEST_START} || body || {REQUEST_END} as request from fx_bodies)
select '# Veille IA: Résumé hebdomadaire du {PERIOD}' || chr(10) || chr(10) ||
  case when count(*) = 1 then any_value(request) else {REQUEST_START} ||
    string_agg(request, chr(10) order by newest desc, first_id, slice) || {REQUEST_END} end as digest
from fx_requests having count(*) > 0
"""
)
SQL_LIST = (
    SQL_DOCS_PAGE
    + """,
fx_list as (
  select row_number() over (order by date desc, id) as number, * from fx_page),
fx_entries as (
select number, '## ' || cast(number as varchar) || '. [' || title || '](' || url || ')' || chr(10) ||
  '**Date :** ' || strftime(date, '%Y-%m-%dT%H:%M:%S') || chr(10) || chr(10) ||
  '**Source :** ' || source_name || chr(10) || chr(10) ||
  case when summary is not null then '**Résumé :** ' || summary || chr(10) || chr(10) else '' end ||
  case when description is not null then '**Description :** ' || description || chr(10) || chr(10) else '' end ||
  '**Contenu :**' || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) as block
from fx_list
union all
select 0, '# Articles scrappés de la semaine (' || cast(count(*) as varchar) || ')' || chr(10)
from fx_page having count(*) > 0)
"""
)


def echo():
    """Stands for a user's model: answers with the request."""
    return lambda texts: list(texts)


@query(SQL_BLOCKS.replace("{slice}", str(SLICE)) + "select source, slice, n_articles, newest, first_id, body from fx_bodies")
def digest_blocks(spark, sf_dir):
    return digest.digest_blocks(stored_week(spark, sf_dir), SLICE)


@query(
    SQL_BLOCKS.replace("{slice}", str(SLICE))
    + f"""select row_number() over (order by newest desc, first_id, slice) as position, source, slice,
      {REQUEST_START} || body || {REQUEST_END} as request from fx_bodies"""
)
def digest_request(spark, sf_dir):
    return digest.digest_requests(stored_week(spark, sf_dir), DOCS_AS_OF, slice_articles=SLICE)


@query(SQL_DIGEST)
def digest_result(spark, sf_dir):
    requests = digest.digest_requests(stored_week(spark, sf_dir), DOCS_AS_OF)
    return digest.generate_digest(requests, echo, DOCS_AS_OF).select("digest")


@query(SQL_DIGEST)
def write_digest(spark, sf_dir):
    path = scratch_dir(spark, "digests")
    requests = digest.digest_requests(stored_week(spark, sf_dir), DOCS_AS_OF)
    files.write_digest(digest.generate_digest(requests, echo, DOCS_AS_OF), path, DOCS_AS_OF)
    return files.latest_digest(spark, path).select(F.col("content").alias("digest"))


@query(
    "select 'digest_hebdo_20240131' as name, string_agg(source || ': ' || cast(n as varchar), ', ' order by source) as content "
    "from (select source, count(*) as n from documents group by source)"
)
def latest_digest(spark, sf_dir):
    """A later day's digest is written first; the file changed last is found."""
    path = scratch_dir(spark, "digests")
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat("source", F.lit(": "), F.col("n").cast("string"))
    newer = counted.select("source", line.alias("line")).agg(
        F.expr("listagg(line, ', ') within group (order by source)").alias("digest")
    )
    files.write_digest(newer.select(F.upper("digest").alias("digest")), path, "2024-02-05 09:00:00")
    files.write_digest(newer, path, DOCS_AS_OF)
    return files.latest_digest(spark, path).select("name", "content")


@query(SQL_LIST + "select number, title, source_name from fx_list")
def numbered_articles(spark, sf_dir):
    rows = digest.numbered_articles(week(spark, sf_dir))
    return rows.select(F.col("number").cast("bigint").alias("number"), "title", "source_name")


@query(SQL_LIST + "select number, block from fx_entries")
def full_article_list(spark, sf_dir):
    return digest.full_article_list(stored_week(spark, sf_dir)).select(
        F.col("number").cast("bigint").alias("number"), "block"
    )


@query(SQL_LIST + "select string_agg(block, chr(10) order by number) as document from fx_entries")
def write_full_list(spark, sf_dir):
    blocks = digest.full_article_list(stored_week(spark, sf_dir))
    target = files.write_full_list(blocks, scratch_dir(spark, "lists"), DOCS_AS_OF)
    parts = spark.read.text(target, wholetext=True).select("value", F.col("_metadata.file_name").alias("part"))
    document = parts.agg(F.expr("listagg(value, '') within group (order by part)").alias("value"))
    return document.select(F.regexp_replace("value", r"\n\z", "").alias("document"))


@query(
    SQL_REPORT_PAGE
    + """select count(*) as total_articles, count(distinct source_name) as n_sources,
    count(*) filter (floor(date_diff('second', date, timestamp '2024-01-31 09:00:00') / 86400.0) <= 7) as this_week
    from fx_page"""
)
def report_counters(spark, sf_dir):
    return report.report_counters(month(spark, sf_dir), DOCS_AS_OF)


@query(
    SQL_REPORT_PAGE
    + """select source_name as source, count(*) as n_articles,
    count(*) filter (floor(date_diff('second', date, timestamp '2024-01-31 09:00:00') / 86400.0) <= 7) as this_week
    from fx_page group by 1"""
)
def report_sources(spark, sf_dir):
    return report.report_sources(month(spark, sf_dir), DOCS_AS_OF)


@query(
    SQL_REPORT_PAGE
    + """select id, title, url, source_name as source, strftime(date, '%d/%m/%Y à %H:%M') as date_shown,
    coalesce(summary, '') as summary
    from fx_page order by date desc, id limit 40"""
)
def newest_report_rows(spark, sf_dir):
    return report.newest_report_rows(month(spark, sf_dir))
