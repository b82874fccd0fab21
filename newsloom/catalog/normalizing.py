"""Cleaning, normalisation, filters and scalar functions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.catalog.fixtures import (
    DOCS_AS_OF,
    SQL_DATES,
    SQL_DOCS,
    SQL_PARSED,
    docs,
    raw_dates,
    raw_docs,
    table,
)
from newsloom.catalog.registry import query
from newsloom.functions.urls import ARTICLE_URL, SCHEME_AND_HOST
from newsloom.operators import normalize as ops
from newsloom.operators import summary as summaries
from newsloom.sources import union_batches as union

# DuckDB twin of ``clean_html`` for the references that the pages hold.
SQL_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
SQL_MARKUP = (
    r"(?s)<(?:!--.*?-->"
    r"|(?i:script)\b.*?(?:</(?i:script)\s*>|\z)"
    r"|(?i:style)\b.*?(?:</(?i:style)\s*>|\z)"
    r"|(?i:template)\b.*?</(?i:template)\s*>"
    r'|/?[a-zA-Z][^>=]*(?:=\s*(?:"[^"]*"|' + r"''[^'']*''" + r"|)[^>=]*)*>"
    r"|/?[a-zA-Z][^>]*>"
    r"|[!?][^>]*>)"
)


def sql_unescape(text: str) -> str:
    """Every reference but the ampersand first, so that nothing decodes twice."""
    for pattern, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{pattern}', '{char}', 'g')"
    return text


def sql_clean(text: str) -> str:
    visible = f"regexp_replace({sql_unescape(text)}, '{SQL_MARKUP}', '', 'g')"
    return f"coalesce(trim(regexp_replace({sql_unescape(visible)}, '{SQL_SPACE}', ' ', 'g')), '')"


@query(f"select page_id, {sql_clean('html')} as text from pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.clean_html(F.col("html")).alias("text"))


# Page URLs: a third malformed, some missing.
SQL_PAGE_URL = """case when page_id % 3 = 1 then replace(url, '://', ':/')
    when page_id % 3 = 2 and url like '%/en/%' then null else url end"""


def pages(spark, sf_dir) -> DataFrame:
    url = F.expr(SQL_PAGE_URL)
    return table(spark, sf_dir, "pages").select("page_id", "html", url.alias("url"))


@query(
    f"""select page_id, case when regexp_matches(url, '(?i){ARTICLE_URL}') then url else '' end as url
    from (select page_id, {SQL_PAGE_URL} as url from pages)"""
)
def normalize_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", fn.normalize_url(F.col("url")).alias("url"))


@query(
    f"""select page_id, coalesce(regexp_matches(url, '{SCHEME_AND_HOST}'), false) as valid
    from (select page_id, {SQL_PAGE_URL} as url from pages)"""
)
def valid_feed_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", fn.has_scheme_and_host(F.col("url")).alias("valid"))


@query(f"select event_id, date from ({SQL_PARSED})")
def normalize_date(spark, sf_dir):
    return raw_dates(spark, sf_dir).select(
        "event_id", fn.parse_date(F.col("raw")).cast("timestamp_ntz").alias("date")
    )


@query(
    f"""select event_id, coalesce(strftime(date, '%d/%m/%Y'), '') as day,
    coalesce(case event_id % 8 when 5 then raw when 6 then raw
      else strftime(date, '%d/%m/%Y à %H:%M') end, '') as shown
    from ({SQL_PARSED})"""
)
def format_date(spark, sf_dir):
    return raw_dates(spark, sf_dir).select(
        "event_id",
        F.coalesce(fn.format_day(fn.parse_date(F.col("raw"))), F.lit("")).alias("day"),
        fn.format_report_date(F.col("raw")).alias("shown"),
    )


@query(
    f"""select event_id, date from ({SQL_PARSED})
    where date is null or date >= timestamp '2024-01-24 09:00:00'"""
)
def ingest_recent(spark, sf_dir):
    parsed = raw_dates(spark, sf_dir).select("event_id", fn.parse_date(F.col("raw")).alias("date"))
    kept = ops.keep_recent(parsed, DOCS_AS_OF)
    return kept.select("event_id", F.col("date").cast("timestamp_ntz").alias("date"))


@query(
    """select o_orderkey, array_to_string(list_sort(list_distinct(list_filter(
      [trim(o_orderstatus), trim(' ' || o_orderpriority), trim(o_orderstatus), ''], lambda x: x <> ''))), ',')
      as categories, trim(o_orderpriority) as single
    from orders"""
)
def normalize_categories(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    listed = F.array(status, F.concat(F.lit(" "), priority), status, F.lit(""))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array_join(fn.normalize_categories(listed), ",").alias("categories"),
        F.array_join(fn.normalize_categories(fn.parse_categories(priority)), ",").alias("single"),
    )


@query(
    r"""select p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand || '!'), '\W+', '-', 'g'), '-') as slug
    from part"""
)
def slugify(spark, sf_dir):
    name = F.concat("p_name", F.lit(" & "), "p_brand", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.slugify(name).alias("slug"))


@query(
    """select c_custkey, translate(lower(trim('  ' || c_name || '_' || c_mktsegment || ' ')), '-_#', '  #') as name
    from customer"""
)
def match_name(spark, sf_dir):
    name = F.concat(F.lit("  "), "c_name", F.lit("_"), "c_mktsegment", F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.match_name(name).alias("name"))


@query(
    """with stems as (
      select p_partkey, replace(lower(p_brand) || '-' || p_name || '-a1b', '-', ' ') as stem from part)
    select p_partkey, array_to_string(list_transform(string_split(stem, ''), lambda c, i:
      case when i > 1 and regexp_matches(stem[i - 1], '\\p{L}') then lower(c) else upper(c) end), '') as title
    from stems"""
)
def title_case(spark, sf_dir):
    stem = F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_name"), F.lit("-a1b"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.title_case(stem).alias("title"))


# -- articles ---------------------------------------------------------------

# Pages as raw articles; the JSON-style date comes with an offset.
SQL_PAGE_ARTICLE = f"""
select page_id, nullif({sql_clean("'<h1>' || url || '</h1>'")}, '') as title,
  case when regexp_matches({SQL_PAGE_URL}, '(?i){ARTICLE_URL}') then {SQL_PAGE_URL} end as url,
  nullif(split_part(url, '/', 3), '') as source, {sql_clean('html')} as content
from pages
"""


def raw_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("<h1>"), F.col("url"), F.lit("</h1>")).alias("title"),
        F.split_part("url", F.lit("/"), F.lit(3)).alias("source"),
        F.expr(SQL_PAGE_URL).alias("url"),
        F.lit("2024-01-31T10:00:00+01:00").alias("date"),
        F.lit("2024-01-31T09:00:00").alias("scraped_at"),
        F.lit("").alias("author"),
        F.col("html").alias("content"),
        F.lit("Web").alias("categories"),
        F.col("url").alias("image_url"),
    )


@query(
    f"""select title, url, source, timestamp '2024-01-31 09:00:00' as scraped_at,
    timestamp '2024-01-31 09:00:00' as date, cast(null as varchar) as author,
    cast(null as varchar) as summary, cast(null as varchar) as description,
    nullif(content, '') as content, 'Web' as categories,
    (select p.url from pages p where p.page_id = a.page_id) as image_url
    from ({SQL_PAGE_ARTICLE}) a"""
)
def normalize_article(spark, sf_dir):
    rows = ops.normalize_articles(raw_pages(spark, sf_dir))
    return rows.withColumns(
        {
            "scraped_at": F.col("scraped_at").cast("timestamp_ntz"),
            "date": F.col("date").cast("timestamp_ntz"),
            "categories": F.array_join("categories", ","),
        }
    )


@query(
    f"""select source, count(*) as n, count(title) as titles, count(url) as urls, count(date) as dates,
    cast(sum(length(content)) as bigint) as content_chars
    from (select a.source, a.title, a.url, date '2024-01-31' as date, nullif(a.content, '') as content
          from ({SQL_PAGE_ARTICLE}) a
          union all
          select source, 'Document', 'https://' || source, date '2024-01-31',
                 nullif(trim(regexp_replace(text, '{SQL_SPACE}', ' ', 'g')), '') from documents)
    group by source"""
)
def normalize_batch(spark, sf_dir):
    """Whole pages and documents in one batch: no row is dropped."""
    tagged = [
        batch.withColumn("categories", categories)
        for batch, categories in (
            (raw_pages(spark, sf_dir), F.array("categories")),
            (raw_docs(spark, sf_dir), F.col("categories")),
        )
    ]
    return (
        ops.normalize_articles(union(*tagged))
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("title").alias("titles"),
            F.count("url").alias("urls"),
            F.count("date").alias("dates"),
            F.sum(F.length("content")).alias("content_chars"),
        )
    )


@query(
    f"""select case when url is null then 'url missing or malformed' else 'ok' end as status, count(*) as n
    from (select case when regexp_matches({SQL_PAGE_URL}, '(?i){ARTICLE_URL}') then {SQL_PAGE_URL} end as url
          from pages) group by 1"""
)
def reject_invalid(spark, sf_dir):
    valid, rejects = ops.split_rejects(ops.normalize_articles(raw_pages(spark, sf_dir)))
    both = valid.select(F.lit("ok").alias("status")).union(rejects.select("reason"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select coalesce(nullif(lang, 'de'), '') as title, case when lang = 'fr' then '' else
    'https://' || source || '.example.com/d/' || cast(doc_id as varchar) end as url,
    '2024-01-30' as date, timestamp '2024-01-31 09:00:00' as scraped_at, source, text as content from documents"""
)
def entry_to_raw(spark, sf_dir):
    entries = docs(spark, sf_dir).select(
        F.nullif("lang", F.lit("de")).alias("title"),
        F.when(F.col("lang") != "fr", F.col("url")).alias("link"),
        F.lit("2024-01-30").alias("published"),
        F.col("source_name").alias("source"),
        "summary",
        "description",
        F.array(F.struct(F.col("content").alias("value"))).alias("content"),
        F.lit(None).cast("string").alias("author"),
        F.array("lang").alias("categories"),
    )
    raw = ops.entry_to_raw(entries, DOCS_AS_OF)
    scraped = F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at")
    return raw.select("title", "url", "date", scraped, "source", "content")


@query("select doc_id, text as from_list, text as from_value, text as from_text, cast(null as varchar) as from_empty from documents")
def content_first(spark, sf_dir):
    shapes = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array(F.struct(F.col("text").alias("value")), F.struct(F.lit("other").alias("value"))).alias("from_list"),
        F.struct(F.col("text").alias("value")).alias("from_value"),
        F.col("text").alias("from_text"),
        F.array().cast("array<struct<value:string>>").alias("from_empty"),
    )
    return shapes.select(
        "doc_id",
        *[
            fn.content_first(F.col(name), shapes.schema[name].dataType).alias(name)
            for name in shapes.columns
            if name != "doc_id"
        ],
    )


@query(
    f"""select id, case when length(summary) > 50 then 'Résumé' when length(description) > 50 then 'Description'
      when length(content) > 50 then 'Contenu' end as label,
    case when length(summary) > 50 then summary when length(description) > 50 then description
      when length(content) > 2000 then content[1:2000] || '...'
      when length(content) > 50 then content end as text
    from ({SQL_DOCS})"""
)
def best_text(spark, sf_dir):
    best = docs(spark, sf_dir).select("id", ops.best_text().alias("best"))
    return best.select("id", "best.label", "best.text")


@query(
    """select c_custkey, coalesce(case when c_acctbal > 0 then c_name end,
      nullif(c_mktsegment, 'BUILDING'), 'Unknown') as source
    from customer"""
)
def source_label(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("source_name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("source"),
    )
    return named.select("c_custkey", ops.source_label(named).alias("source"))


@query(
    f"""select id, 'with text' as articles, content from ({SQL_DOCS})
    union all select id, 'titles only', title from ({SQL_DOCS})"""
)
def title_fallback(spark, sf_dir):
    rows = docs(spark, sf_dir).select("id", "title", "summary", "content")
    bare = rows.withColumns({"summary": F.lit(""), "content": F.lit(None).cast("string")})
    filled = ops.title_fallback(rows).select("id", F.lit("with text").alias("articles"), "content")
    return filled.union(ops.title_fallback(bare).select("id", F.lit("titles only"), "content"))


# -- summaries --------------------------------------------------------------


@query(
    f"""with texts as (
      select id, trim(regexp_replace(content, '{SQL_SPACE}', ' ', 'g')) as text from ({SQL_DOCS})),
    sentences as (
      select id, unnest(s) as sentence, generate_subscripts(s, 1) as pos
      from (select id, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) as s
            from texts)),
    usage as (
      select word, 1000000 // count(*) as weight
      from (select distinct id, unnest(string_split(lower(text), ' ')) as word from texts) group by word),
    words as (
      select id, pos, len(string_split(sentence, ' ')) as n_words,
             unnest(string_split(lower(sentence), ' ')) as word
      from sentences),
    scored as (
      select id, pos, n_words, cast(sum(weight) as bigint) // n_words as score
      from words join usage using (word) group by id, pos, n_words),
    ranked as (
      select id, pos, row_number() over w as rank,
             sum(least(n_words, 130)) over (w rows unbounded preceding) as used,
             sum(n_words) over (partition by id) as doc_words
      from scored window w as (partition by id order by score desc, pos))
    select id, string_agg(array_to_string(string_split(sentence, ' ')[1:130], ' '), ' ' order by pos) as summary
    from ranked join sentences using (id, pos)
    where rank = 1 or used <= 130 or doc_words < 30 group by id"""
)
def extractive_summary(spark, sf_dir):
    return summaries.extractive_summary(docs(spark, sf_dir))


def lead_sentence():
    """Stands for a user's model in the hook's query."""
    return lambda texts: [text.split(". ")[0] for text in texts]


@query(f"select id, split_part(content, '. ', 1) as lead from ({SQL_DOCS})")
def summarize_hook(spark, sf_dir):
    rows = docs(spark, sf_dir)
    texts = rows.select("id", summaries.summary_text(rows).alias("text"))
    return summaries.map_texts(texts, lead_sentence, "text", "lead").select("id", "lead")
