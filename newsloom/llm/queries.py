"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.centroids import cluster_vectors
from newsloom.llm.collocations import collocations
from newsloom.llm.exact_dedup import exact_groups
from newsloom.llm.line_dedup import drop_repeated_lines
from newsloom.llm.lm_scoring import score_texts
from newsloom.llm.mixing import NO_ID, mix_slots
from newsloom.llm.near_dedup import near_duplicates
from newsloom.llm.ngram_join import similar_documents
from newsloom.llm.packing import pack
from newsloom.llm.pii import pseudonymise
from newsloom.llm.quality import quality
from newsloom.llm.substring_dedup import drop_repeated_passages
from newsloom.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with its DuckDB twin."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    with normal as (select doc_id, {LOWER} as body from documents),
    grouped as (select body, max(doc_id) as keep_id, count(*) as group_size from normal group by body)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
    from normal join grouped using (body)
    """
)
def op8_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep=F.max)


@query()
def op10_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


URL_RULES = """
    values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    as rules(host, path, action)
"""


@query(
    r"""
    with recursive rules(h, p, action) as (
        values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ),
    cut as (
        select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest
        from pages
    ),
    parsed as (
        select page_id, html,
               coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
               coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
               regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail
        from cut
    ),
    found as (
        select host || tail as node, regexp_extract(tag, '(?i)href\s*=\s*["'']([^"'']*)', 1) as target
        from (select host, tail, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\bcanonical\b[^>]*>')) as tag from parsed)
        where contains(tag, '://')
    ),
    edge as (
        select node as a, regexp_replace(regexp_replace(target, '^.*?://', ''), '#.*$', '') as b from found
        union select regexp_replace(regexp_replace(target, '^.*?://', ''), '#.*$', ''), node from found
    ),
    reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
    place as (
        select host, path from parsed
        union select regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) from edge
    ),
    best as (
        select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(action, length(h || p)) as action
        from place join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        group by host, path
    ),
    carried as (
        select r.a as node, bool_or(b.action = 'allow') as allowed
        from (select a, b from reach union select a, a from edge) r
        join best b on b.host = regexp_extract(r.b, '^[^/?#]*') and b.path = regexp_extract(r.b, '^[^/?#]*([^?#]*)', 1)
        group by r.a
    )
    select page_id, p.host as host, p.path as path, rule,
           coalesce(action, case when not allowed then 'block' end, 'allow') as verdict
    from parsed p
    left join best using (host, path)
    left join carried c on c.node = p.host || p.tail
    """
)
def op5_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"select * from {URL_RULES}"))


PSEUDONYM_KEY = "a key of the test tables; keep a real one in a secret store"


@query()
def op1_pii_pseudonyms(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@query(
    r"""
    with lines as (
        select doc_id, pos, line,
               translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos
              from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
    ),
    common as (
        select key, max(doc_id) as keeper from lines where length(key) >= 40
        group by key having count(distinct doc_id) >= 5
    ),
    judged as (select l.*, c.key is not null and doc_id <> keeper as drops from lines l left join common c using (key))
    select doc_id, count(*) as n_lines, count(*) filter (drops) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not drops), '')) as kept_sha256
    from judged group by doc_id
    """
)
def op3_line_dedup(spark, sf_dir):
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256")
    )


def _similar_sql(percent: int, columns: str) -> str:
    """Components of documents linked by their sets of five-word shingles."""
    return rf"""
    with recursive tokens as (
        select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents
    ),
    sets as (
        select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
               else list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) end as s
        from tokens
    ),
    same as (select s, min(doc_id) as a, len(s) as n from sets where len(s) > 0 group by s),
    entries as (select a, n, unnest(s) as g from same),
    shared as (
        select x.a as a, y.a as b from entries x join entries y on x.g = y.g and x.a < y.a
        group by x.a, y.a, x.n, y.n having 100 * count(*) >= {percent} * (x.n + y.n - count(*))
    ),
    link as (select a, b from shared union select b, a from shared),
    reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
    named as (
        select same.s as s, least(same.a, coalesce(min(reach.b), same.a)) as component_id
        from same left join reach on reach.a = same.a group by same.s, same.a
    ),
    judged as (
        select doc_id, len(sets.s) as n_shingles, coalesce(component_id, doc_id) as component_id
        from sets left join named on named.s = sets.s
    )
    select {columns} from judged
    """


@query(_similar_sql(80, "doc_id, n_shingles, component_id"))
def op11_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))


@query(
    rf"""
    with pieces as (
        select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array({LOWER}, '[.,;:!?
-
]')) as piece
        from documents
    ),
    listed as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from pieces),
    words as (select lang, cast(count(*) as hugeint) as n from (select lang, unnest(w) from listed) group by lang),
    starts as (
        select lang, w, size, unnest(range(1, len(w) - size + 2)) as i
        from listed, (select unnest([1, 2, 3, 4]) as size) where len(w) >= size
    ),
    counts as (select lang, w[i:i + size - 1] as p, count(*) as f from starts group by all),
    candidates as (select lang, p, f as a from counts where len(p) > 1 and f >= 30),
    cuts as (
        select c.lang as lang, c.p as p, c.a as a, k, x.f as l, y.f as r,
               cast(2000000 * c.a as hugeint) // (x.f + y.f) as score
        from (select *, unnest(range(1, len(p))) as k from candidates) c
        join counts x on x.lang = c.lang and x.p = c.p[1:k]
        join counts y on y.lang = c.lang and y.p = c.p[k + 1:]
    ),
    best as (
        select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1
    ),
    inside as (
        select lang, p[i:i + size - 1] as p, max(a) as longer
        from (select lang, p, a, size, unnest(range(1, len(p) - size + 2)) as i
              from candidates, (select unnest([2, 3]) as size) where len(p) > size)
        group by all
    ),
    named as (
        select b.lang as lang, array_to_string(b.p, ' ') as phrase, a, l, r, score
        from best b left join inside i on i.lang = b.lang and i.p = b.p
        where longer is null or 100 * longer < 80 * a
    ),
    ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named
    )
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
    from ranked join words using (lang) where rank <= 2000
    """
)
def op12_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def _clusters_sql(rounds: int, size: int, clusters: int) -> str:
    """Rounds of assigning and moving, one after the other."""

    def nearest(centroids: str) -> str:
        return f"""
            select vec_id, v, cluster, distance from (
                select vec_id, v, cluster, cast(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as distance
                from vectors, {centroids})
            qualify row_number() over (partition by vec_id, v order by distance, cluster) = 1
        """

    steps = []
    for i in range(rounds):
        steps.append(f"near{i} as ({nearest(f'moved{i}')})")
        steps.append(
            f"""means{i} as (
                select cluster, list(mean order by place) as c from (
                    select cluster, place, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as mean
                    from (select cluster, unnest(v) as x, unnest(range({size})) as place from near{i})
                    group by cluster, place)
                group by cluster)"""
        )
        steps.append(
            f"moved{i + 1} as (select cluster, coalesce(m.c, o.c) as c from moved{i} o left join means{i} m using (cluster))"
        )
    return f"""
    with vectors as (
        select vec_id, list_transform(embedding, lambda x: cast(floor({size} * cast(x as double)) as bigint)) as v
        from embeddings
        where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}
    ),
    moved0 as (
        select row_number() over (order by h) - 1 as cluster, v as c
        from (select sha256('1:' || vec_id) as h, v from vectors order by h limit {clusters})
    ),
    {", ".join(steps)},
    last as ({nearest(f"moved{rounds}")})
    select vec_id, cast(cluster as integer) as cluster, distance,
           cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
           cast(sum(distance) over () as bigint) as inertia,
           sha256(array_to_string(c, ',')) as centroid_sha256
    from last join moved{rounds} using (cluster)
    """


@query(_clusters_sql(3, 64, 16))
def op13_centroid_clustering(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query(_similar_sql(75, "doc_id, n_shingles, component_id, doc_id = component_id as kept"))
def op6_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query()
def op7_substring_dedup(spark, sf_dir):
    return drop_repeated_passages(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("row.text", 256).alias("kept_sha256")
    )


@query()
def op4_source_mixing(spark, sf_dir):
    slots = mix_slots(table(spark, sf_dir, "documents"))
    return slots.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "source", "block", "slot", "release", "deadline"
    )


@query()
def op9_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
