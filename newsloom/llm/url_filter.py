"""URL rules, with block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import lower_ascii
from newsloom.llm.components import connected_components
from newsloom.session import written

LINK_TAG = r"(?is)<link\b[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; NULL without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host(rest: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The page that an URL names: host, path and query, whatever the scheme and fragment."""
    rest = after_scheme(url)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.when(rest.isNotNull(), F.concat(host(rest), tail))


def resolved(target: Column, url: Column) -> Column:
    """``target`` as an absolute URL, seen from ``url``."""
    clean = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(url, "://", 1)
    origin = F.concat(scheme, F.lit("://"), host(after_scheme(url)))
    folder = F.regexp_extract(path(after_scheme(url)), r"^(.*/)?", 1)
    return (
        F.when(F.instr(clean, "://") > 0, clean)
        .when(clean.startswith("//"), F.concat(scheme, F.lit(":"), clean))
        .when(clean.startswith("/"), F.concat(origin, clean))
        .when(clean != "", F.concat(origin, F.when(folder == "", "/").otherwise(folder), clean))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) between page nodes: canonical links and refresh redirects in ``html``."""

    def href(tag: Column) -> Column:
        return F.concat(*[F.regexp_extract(tag, HREF, group) for group in (1, 2, 3)])

    links = F.filter(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)), lambda t: F.rlike(t, F.lit(CANONICAL)))
    metas = F.filter(F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda t: F.rlike(t, F.lit(REFRESH)))
    targets = F.concat(
        F.transform(links, href), F.transform(metas, lambda t: F.regexp_extract(t, REFRESH_URL, 1))
    )
    pairs = F.transform(targets, lambda t: _pair(F.col("url"), resolved(t, F.col("url"))))
    return _edges(pages.filter("url is not null and html is not null").select(F.explode(pairs).alias("pair")))


def _pair(url: Column, target: Column) -> Column:
    return F.struct(node(url).alias("src"), node(target).alias("dst"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair.src", "pair.dst").filter("src <> dst")


def _ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule of each distinct (host, path) that has one.

    A place asks for each of its host's last labels, as many as a rule can have, with each prefix of its path
    as long as some rule's path. So rules are found by equality, however many a host has.
    """
    clean = rules.select(
        F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), "action"
    )
    lengths = clean.agg(F.sort_array(F.collect_set(F.char_length("rule_path")))).scalar()
    labels = clean.agg(F.max(F.size(F.split("rule_host", r"\.")))).scalar()
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.coalesce("labels", F.lit(1)))),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    fitting = F.filter("lengths", lambda n: n <= F.char_length("path"))
    asked = (
        places.distinct()
        .select("host", "path", lengths.alias("lengths"), labels.alias("labels"))
        .select("host", "path", F.explode(suffixes).alias("rule_host"), fitting.alias("lengths"))
        .select("host", "path", "rule_host", F.explode("lengths").alias("n"))
        .select("host", "path", "rule_host", F.expr("left(path, n)").alias("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    best = F.struct(F.char_length(rule), (F.col("action") == "allow"), rule)
    return (
        asked.join(clean, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(rule.alias("rule"), "action"), best).alias("best"))
        .select("host", "path", "best.rule", "best.action")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    ``rules`` (host, path, action: allow or block) fit a host and its subdomains
    when the URL's path starts with the rule's; the longest wins, allow before block at equal length.
    URLs joined by canonical links, refresh redirects or ``redirects`` (url,
    target) are aliases. An URL without rule of its own takes the decision of its
    aliases: allow if one of them is explicitly allowed, else block if one is
    blocked, else allow. Aliases that are no pages count too.

    NULL, or an URL without ``://``, has empty host and path, no rule and no alias.
    Repeated rows each get a row. NULL html has no links. An empty table gives an
    empty result. Other columns are ignored.
    """
    rest = after_scheme(F.col("url"))
    parsed = pages.select(
        "page_id", host(rest).alias("host"), path(rest).alias("path"), node(F.col("url")).alias("node")
    )
    edges = link_edges(pages)
    if redirects is not None:
        given = F.explode(F.array(_pair(F.col("url"), F.col("target"))))
        edges = edges.unionByName(_edges(redirects.select(given.alias("pair"))))
    members = written(connected_components(edges), "aliases")
    aliases = members.select(
        "node", "component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")
    )
    ruled = written(
        _ruled(parsed.select("host", "path").unionByName(aliases.select("host", "path")), rules), "ruled"
    )
    blocked = (
        aliases.join(ruled, ["host", "path"])
        .groupBy("component")
        .agg(F.max(F.col("action") == "allow").alias("allowed"))
        .filter("not allowed")
        .join(members, "component")
        .select("node", F.lit("block").alias("carried"))
    )
    return (
        parsed.join(ruled, ["host", "path"], "left")
        .join(blocked, "node", "left")
        .select(
            "page_id", "host", "path", "rule", F.coalesce("action", "carried", F.lit("allow")).alias("verdict")
        )
    )
