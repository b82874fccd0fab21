"""Retrieval, statistics and upserts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.catalog.fixtures import (
    DOCS_AS_OF,
    ORDERS_AS_OF,
    SQL_ARTICLES,
    SQL_DOCS,
    SQL_ORDERS_STORE,
    docs,
    docs_store,
    order_articles,
    order_sources,
    orders_store,
    raw_docs,
    table,
)
from newsloom.catalog.registry import query
from newsloom.operators.dedup import first_wins, insert_if_absent as insert_absent
from newsloom.operators.match import first_url_per_source as first_urls
from newsloom.operators.match import group_by_source as grouped_by_source
from newsloom.operators.match import match_feeds
from newsloom.operators.normalize import normalize_articles
from newsloom.operators.summary import with_extractive_summary
from newsloom.operators.tables import (
    append,
    create_store,
    new_categories,
    new_links,
    partition_day,
    read_store,
    surrogate_key,
)
from newsloom.operators.tables import upsert_sources as sources_after_upsert
from newsloom.plans import retrieval, statistics
from newsloom.plans.ingest import ingest
from newsloom.session import scratch_dir, written

ARTICLE_COLUMNS = ["id", "title", "url", "source_id", "date", "summary", "source_name", "source_url"]


def joined_categories() -> Column:
    return F.array_join("categories", ",").alias("categories")


def edge(articles: DataFrame) -> DataFrame:
    """Article columns with the category list as text."""
    return articles.select(*ARTICLE_COLUMNS, joined_categories())


SQL_ARTICLE_ROW = """
select a.id, a.title, a.url, a.source_id, a.date, {summary} as summary,
       s.name as source_name, s.url as source_url, {categories} as categories
from fx_articles a join fx_sources s on a.source_id = s.id
"""
SQL_WIDE = SQL_ARTICLE_ROW.format(summary="a.summary", categories="coalesce(l.categories, '')") + (
    " left join fx_lists l on l.article_id = a.id"
)


@query(
    SQL_ORDERS_STORE
    + SQL_ARTICLE_ROW.format(summary="coalesce(a.summary, '')", categories="coalesce(l.categories, '')")
    + """ left join fx_lists l on l.article_id = a.id
    where a.date >= timestamp '2001-07-25 00:00:00' order by a.date desc, a.id limit 25"""
)
def recent_articles(spark, sf_dir):
    return edge(retrieval.recent_articles(orders_store(spark, sf_dir), ORDERS_AS_OF, days=7, limit=25))


@query(
    SQL_ORDERS_STORE
    + SQL_ARTICLE_ROW.format(summary="a.summary", categories="'PROMO'")
    + """ where a.id in (select article_id from fx_links where category = 'PROMO')
    order by a.date desc, a.id limit 10"""
)
def articles_by_category(spark, sf_dir):
    return edge(retrieval.articles_by_category(orders_store(spark, sf_dir), "PROMO", limit=10))


@query(
    SQL_ORDERS_STORE
    + SQL_WIDE
    + """ where a.id in (select article_id from fx_links where category = 'PROMO')
    order by a.date desc, a.id limit 10"""
)
def articles_by_category_full(spark, sf_dir):
    return edge(
        retrieval.articles_by_category(orders_store(spark, sf_dir), "PROMO", limit=10, all_categories=True)
    )


@query(SQL_ORDERS_STORE + SQL_WIDE + " where a.url = 'https://example.com/o/7'")
def article_by_url(spark, sf_dir):
    return edge(retrieval.article_by_url(orders_store(spark, sf_dir), "https://example.com/o/7"))


@query(
    SQL_ORDERS_STORE
    + SQL_WIDE
    + " where a.id in (select o_orderkey from orders where o_orderpriority = '1-URGENT')"
)
def articles_by_urls(spark, sf_dir):
    store = orders_store(spark, sf_dir)
    wanted = order_articles(spark, sf_dir).filter("summary = '1-URGENT'").select("url")
    return edge(retrieval.articles_by_urls(store, wanted))


def stored_docs(spark, sf_dir):
    """The documents in a store on disk, partitioned by day."""
    path = scratch_dir(spark, "store")
    ingest(path, normalize_articles(raw_docs(spark, sf_dir)), DOCS_AS_OF)
    return read_store(spark, path)


SQL_STORED = f"""
select id, title, url, source_name, date, array_to_string(list_sort([lang, source_name]), ',') as categories
from ({SQL_DOCS})
"""


@query(f"select title, url, source_name, date, categories from ({SQL_STORED}) where title like '%(fr)'")
def articles_by_urls_stored(spark, sf_dir):
    """A plain table of URLs against a store partitioned by day."""
    wanted = docs(spark, sf_dir).filter("lang = 'fr'").select("url")
    found = retrieval.articles_by_urls(stored_docs(spark, sf_dir), wanted)
    return found.select(
        "title", "url", "source_name", F.col("date").cast("timestamp_ntz").alias("date"), joined_categories()
    )


@query(
    f"""select source_name, date, count(*) as n from (
      select * from ({SQL_STORED}) where title like '%(de)' and date >= (
        select min(date) from (select date from ({SQL_STORED}) where title like '%(de)' order by date desc limit 30))
      order by date desc) group by 1, 2
    having date > (select min(date) from (select date from ({SQL_STORED}) where title like '%(de)' order by date desc limit 30))"""
)
def articles_by_category_stored(spark, sf_dir):
    """The newest 30 of a category in a store partitioned by day, counted by source and day; the
    last day, of which the page may hold only a part, is left out."""
    page = retrieval.articles_by_category(stored_docs(spark, sf_dir), "de", limit=30)
    date = F.col("date").cast("timestamp_ntz")
    counted = page.groupBy("source_name", date.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("date") > page.agg(F.min(date)).scalar())


@query(SQL_ORDERS_STORE + "select name from fx_categories")
def all_categories(spark, sf_dir):
    return retrieval.all_categories(orders_store(spark, sf_dir))


@query(SQL_ORDERS_STORE + "select article_id, categories from fx_lists")
def categories_per_article(spark, sf_dir):
    lists = retrieval.category_lists(orders_store(spark, sf_dir))
    return lists.select("article_id", joined_categories())


@query(
    SQL_ORDERS_STORE
    + """select (select count(*) from fx_articles) as total_articles,
    (select count(*) from fx_sources) as total_sources,
    (select count(*) from fx_categories) as total_categories"""
)
def stats_totals(spark, sf_dir):
    return statistics.totals(orders_store(spark, sf_dir))


@query(
    SQL_ORDERS_STORE
    + """select s.name, count(a.id) as n
    from (select id, name from fx_sources union all select -1, 'Silent') s
    left join fx_articles a on a.source_id = s.id
    group by s.id, s.name"""
)
def stats_by_source(spark, sf_dir):
    """All orders; one source has none."""
    store = orders_store(spark, sf_dir)
    silent = spark.range(1).selectExpr("cast(-1 as bigint) as id", "'Silent' as name", "'' as url")
    return statistics.by_source(store._replace(sources=store.sources.unionByName(silent)))


@query(
    SQL_ORDERS_STORE
    + """select c.name, count(l.article_id) as n from fx_categories c
    left join fx_links l on l.category = c.name group by c.name"""
)
def stats_by_category(spark, sf_dir):
    return statistics.by_category(orders_store(spark, sf_dir))


@query(
    SQL_ORDERS_STORE
    + """select cast(date as date) as day, count(*) as n from fx_articles
    where date >= timestamp '2001-07-25 00:00:00' group by 1"""
)
def stats_by_day(spark, sf_dir):
    return statistics.by_day(order_articles(spark, sf_dir), ORDERS_AS_OF)


# -- sources ----------------------------------------------------------------


@query("select distinct source from documents")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct()


@query(
    """select c_mktsegment as source, count(*) as n_articles,
    min(o_orderdate) as first_date, max(o_orderdate) as last_date
    from orders join customer on o_custkey = c_custkey group by 1"""
)
def group_by_source(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("source")
    )
    return grouped_by_source(order_articles(spark, sf_dir).join(segments, "source_id"))


@query(
    """select source, arg_min('https://' || source || '.example.com/d/' || cast(doc_id as varchar), doc_id)
    as source_url from documents group by source"""
)
def first_url_per_source(spark, sf_dir):
    return first_urls(docs(spark, sf_dir).select(F.col("source_name").alias("source"), "url", "id"), "id")


@query(
    """with feeds as (
      select s_suppkey as seq, ' ' || case when s_suppkey % 3 = 1 then 'Other' else 'Src' end
               || cast(s_suppkey as varchar) || '! ' as name,
             'https://feeds.example.com/a/' || cast(s_suppkey as varchar) as url from supplier
      union all
      select 1000000000 + s_suppkey, case when s_suppkey % 3 = 1 then 'OTHER' else 'SRC' end || cast(s_suppkey as varchar),
             'https://feeds.example.com/b/' || cast(s_suppkey as varchar) from supplier),
    keyed as (
      select trim(regexp_replace(lower(name), '\\W+', '-', 'g'), '-') as key,
             arg_min(name, seq) as name, arg_min(url, seq) as url from feeds group by 1)
    select source, name as feed_name, url as feed_url, key is not null as matched
    from (select distinct source from documents)
    left join keyed on trim(regexp_replace(lower(source), '\\W+', '-', 'g'), '-') = key"""
)
def match_feed(spark, sf_dir):
    """Every third feed is of a source that has no documents."""
    key = F.col("s_suppkey").cast("string")
    kind = F.when(F.col("s_suppkey") % 3 == 1, "Other").otherwise("Src")
    suppliers = table(spark, sf_dir, "supplier")
    feeds = suppliers.select(
        F.col("s_suppkey").alias("seq"),
        F.concat(F.lit(" "), kind, key, F.lit("! ")).alias("name"),
        F.concat(F.lit("https://feeds.example.com/a/"), key).alias("url"),
    ).union(
        suppliers.select(
            F.col("s_suppkey") + 1000000000,
            F.concat(F.upper(kind), key),
            F.concat(F.lit("https://feeds.example.com/b/"), key),
        )
    )
    return match_feeds(table(spark, sf_dir, "documents").select("source").distinct(), feeds)


@query(
    """with stored as (
      select c_name as name, 'https://feeds.example.com/' || cast(c_custkey as varchar) as url
      from customer where c_nationkey < 15),
    incoming as (
      select c_name as name, 'https://feeds.example.com/' || cast(c_custkey as varchar) || '/v2' as url
      from customer where c_acctbal >= 0)
    select coalesce(s.name, i.name) as name, coalesce(i.url, s.url) as url,
      case when i.name is null then timestamp '2001-01-01' else timestamp '2001-08-01 09:00:00' end as last_updated,
      case when s.name is null then timestamp '2001-08-01 09:00:00' else timestamp '2001-01-01' end as created_at,
      s.name is not null as known
    from stored s full join incoming i on s.name = i.name"""
)
def upsert_sources(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    before = F.lit("2001-01-01 00:00:00Z").cast("timestamp")
    stored = (
        order_sources(spark, sf_dir)
        .join(customers.filter("c_nationkey < 15").select(F.col("c_custkey").alias("id")), "id", "left_semi")
        .select("id", "name", "url", before.alias("last_updated"), before.alias("created_at"))
    )
    incoming = (
        order_sources(spark, sf_dir)
        .join(customers.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id")), "id", "left_semi")
        .select("name", F.concat("url", F.lit("/v2")).alias("url"))
    )
    after = sources_after_upsert(stored, incoming, ORDERS_AS_OF)
    return after.select(
        "name",
        "url",
        F.col("last_updated").cast("timestamp_ntz").alias("last_updated"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        (F.col("id") != surrogate_key(F.col("name"))).alias("known"),
    )


# -- articles ---------------------------------------------------------------


def twice(articles: DataFrame) -> DataFrame:
    """Every article delivered twice; the second copy has another title."""
    first = articles.withColumn("seq", F.lit(0))
    second = articles.withColumn("title", F.concat("title", F.lit(" (copy)"))).withColumn("seq", F.lit(1))
    return first.union(second)


@query(SQL_ARTICLES)
def dedup_first_wins(spark, sf_dir):
    batch = twice(order_articles(spark, sf_dir))
    return first_wins(batch, "url", ("date", "seq")).drop("seq")


@query(f"select * from ({SQL_ARTICLES}) where date >= timestamp '2000-01-01'")
def insert_if_absent(spark, sf_dir):
    articles = order_articles(spark, sf_dir)
    stored = articles.filter("date < timestamp_ntz'2000-01-01 00:00:00'")
    return insert_absent(twice(articles), stored, "url", ("date", "seq")).drop("seq")


@query(
    SQL_ORDERS_STORE
    + """select name from fx_categories where name <> 'UNUSED'
    and name not in (select category from fx_links join fx_articles on id = article_id
                     where date < timestamp '1995-01-02')"""
)
def upsert_categories(spark, sf_dir):
    store = orders_store(spark, sf_dir)
    articles = store.articles.select("id", "date").join(
        retrieval.category_lists(store).withColumnRenamed("article_id", "id"), "id"
    )
    first_day = articles.filter("date < timestamp_ntz'1995-01-02 00:00:00'")
    stored = first_day.select(F.explode("categories").alias("name")).distinct()
    return new_categories(articles, stored).select("name")


@query(
    SQL_ORDERS_STORE
    + """select l.article_id, l.category from fx_links l join fx_articles a on a.id = l.article_id
    where a.date >= timestamp '2000-01-01'"""
)
def link_categories(spark, sf_dir):
    store = orders_store(spark, sf_dir)
    old = store.articles.filter("date < timestamp_ntz'2000-01-01 00:00:00'").select(
        F.col("id").alias("article_id")
    )
    stored = store.links.join(old, "article_id", "left_semi")
    fresh = new_links(store.links, stored)
    names = store.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return fresh.join(names, "category_id").select("article_id", "category")


@query(
    """select 'articles' as store_table, count(*) as n, count(distinct o_orderkey) as n_keys from orders
    union all select 'sources', count(*), count(distinct c_name) from customer
    union all select 'documents', count(*), count(distinct doc_id) from documents"""
)
def surrogate_keys(spark, sf_dir):
    def keys(name: str, rows: DataFrame, natural: str) -> DataFrame:
        return rows.select(surrogate_key(F.col(natural)).alias("id")).agg(
            F.lit(name).alias("store_table"),
            F.count("id").alias("n"),
            F.countDistinct("id").alias("n_keys"),
        )

    return (
        keys("articles", order_articles(spark, sf_dir), "url")
        .union(keys("sources", order_sources(spark, sf_dir), "name"))
        .union(keys("documents", docs(spark, sf_dir), "url"))
    )


@query(
    """select 'articles' as store_table, count(*) as n from documents
    union all select 'sources', count(distinct source) from documents
    union all select 'categories', count(distinct lang) from documents
    union all select 'article_categories', count(*) from documents"""
)
def store_init(spark, sf_dir):
    """Create, fill, create again (which changes nothing), and read back."""
    path = scratch_dir(spark, "store")
    create_store(spark, path)
    fixture = docs_store(spark, sf_dir)
    loaded = F.lit(f"{DOCS_AS_OF}Z").cast("timestamp")
    missing = [F.lit(None).cast("string").alias(name) for name in ("author", "image_url")]
    articles = fixture.articles.select(
        "*",
        *missing,
        partition_day(F.col("date")).alias("date_day"),
        loaded.alias("scraped_at"),
        loaded.alias("created_at"),
    )
    days = articles.select(F.col("id").alias("article_id"), "date_day")
    append("articles", articles, path)
    append("article_categories", fixture.links.join(days, "article_id"), path)
    append("categories", fixture.categories, path)
    append(
        "sources",
        fixture.sources.select("*", loaded.alias("last_updated"), loaded.alias("created_at")),
        path,
    )
    create_store(spark, path)
    store = read_store(spark, path)

    def size(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("store_table"), F.count(F.lit(1)).alias("n"))

    return (
        size("articles", store.articles)
        .union(size("sources", store.sources))
        .union(size("categories", store.categories))
        .union(size("article_categories", store.links))
    )


# -- ingest -----------------------------------------------------------------


def docs_batch(spark, sf_dir) -> DataFrame:
    """Normalised documents; those without a quality label lack a URL, and
    Spanish ones come a second time under the same URL."""
    labelled = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("key"), F.lit(True).alias("labelled")
    )
    raw = raw_docs(spark, sf_dir).withColumn("key", F.regexp_extract("url", r"(/d/\d+)$", 1))
    raw = raw.join(labelled, "key", "left")
    raw = raw.withColumn("url", F.when(F.col("labelled"), F.col("url")))
    again = raw.filter(F.array_contains("categories", "es"))
    return normalize_articles(raw.withColumn("seq", F.lit(0)).union(again.withColumn("seq", F.lit(1))))


@query(
    """select 'https://' || source || '.example.com/d/' || cast(doc_id as varchar) as url,
    'Document ' || cast(doc_id as varchar) || ' (' || lang || ')' as title, source as source_name,
    case when lang < source then lang || ',' || source else source || ',' || lang end as categories,
    timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 45 as integer)) as date
    from documents where doc_id in (select doc_id from labels)"""
)
def ingest_batch(spark, sf_dir):
    """The store after the same batch was ingested twice, with extracts of the new texts."""
    path = scratch_dir(spark, "store")
    batch = written(docs_batch(spark, sf_dir), "delivery")
    ingest(path, batch, "2024-01-31 09:00:00", summarize=with_extractive_summary)
    ingest(path, batch, "2024-02-01 09:00:00")
    store = read_store(spark, path)
    lists = retrieval.category_lists(store).withColumnRenamed("article_id", "id")
    names = store.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    rows = store.articles.join(names, "source_id").join(lists, "id", "left")
    return rows.select(
        "url", "title", "source_name", joined_categories(), F.col("date").cast("timestamp_ntz").alias("date")
    )


@query(
    """with docs as (
      select d.doc_id, d.lang, d.doc_id in (select doc_id from labels) as labelled from documents d)
    select count(*) + count(*) filter (lang = 'es') as processed,
      count(*) filter (labelled) as inserted,
      count(*) filter (not labelled) + count(*) filter (not labelled and lang = 'es') as rejected,
      count(*) filter (labelled and lang = 'es') as duplicates from docs"""
)
def ingest_counters(spark, sf_dir):
    return ingest(scratch_dir(spark, "store"), docs_batch(spark, sf_dir), "2024-01-31 09:00:00").counters
