"""Column functions on literals."""

import html

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom import functions as fn


def values(spark, function, texts, dtype="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, v {dtype}")
    return [row.r for row in rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


def test_clean_html(spark):
    cases = {
        "<ul><li>one <u>or</u> two</li></ul>": "one or two",
        "a</p><p>b": "ab",
        '<a title="x>y">q</a>': "q",
        "<p title=it's>text</p> it's": "text it's",
        "x<!-- <script> -->y<script>var t='</p>';</script>z": "xyz",
        "<SCRIPT>a</SCRIPT>b<style>c</style><template>d</template>": "b",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "&lt;b&gt;bold&lt;/b&gt; &amp;amp; caf&eacute;": "bold & café",
        "\u00a0 a\u00a0\n\tb\x1f": "a b",
        "<br/>line<br>": "line",
        "": "",
        None: "",
    }
    assert values(spark, fn.clean_html, list(cases)) == list(cases.values())


def test_long_markup_does_not_overflow(spark):
    attributes = " ".join(f'data-{i}="{i}>"' for i in range(5000))
    text = f"<div {attributes}>{'word ' * 50000}</div>" + "<" * 20000
    (cleaned,) = values(spark, fn.clean_html, [text])
    assert cleaned.startswith("word word") and cleaned.count("word") == 50000


ENTITIES = st.sampled_from(
    ["&amp;", "&lt", "&notit;", "&eacute;", "&#233;", "&#xE9", "&#128;", "&#0;", "&#1114112;", "&#x1F600;",
     "&#55296;", "&#1;", "&nosuch;", "&", "#", ";", "a", " ", "x&", "&NotEqualTilde;", "&ampamp;", "é"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ENTITIES, max_size=12).map("".join), min_size=20, max_size=60))
def test_unescape_equals_the_standard_library(spark, texts):
    assert values(spark, fn.unescape_entities, texts) == [html.unescape(text) for text in texts]


@pytest.mark.parametrize(
    "url, kept",
    [
        ("https://sub.water.example/a-b/?c=d", True),
        ("http://localhost:8080/x", True),
        ("http://999.1.1.1", True),
        ("HTTPS://EXAMPLE.COM", True),
        ("https://example.com./?q=1", True),
        ("not-a-url", False),
        ("http://a.com#f", False),
        ("http://a.com/x y", False),
        ("ftp://a.com", False),
        ("http://a_b.com", False),
        ("http://user@a.com", False),
        ("", False),
        (None, False),
    ],
)
def test_normalize_url(spark, url, kept):
    assert values(spark, fn.normalize_url, [url]) == [url if kept else ""]


def test_has_scheme_and_host(spark):
    urls = ["https://a.com/rss", "ftp://a", "a.com", "https://", "mailto:a@b.com", None]
    assert values(spark, fn.has_scheme_and_host, urls) == [True, True, False, False, False, False]


def test_parse_date(spark):
    cases = {
        "1998-07-04T21:15:09+00:00": "1998-07-04 21:15:09",
        "1998-07-04T21:15:09-0330": "1998-07-05 00:45:09",
        "1998-07-04T21:15:09Z": "1998-07-04 21:15:09",
        "1998-07-04T21:15:09": "1998-07-04 21:15:09",
        "1998-07-04 21:15:09": "1998-07-04 21:15:09",
        "1998-07-04": "1998-07-04 00:00:00",
        "1998-7-4": "1998-07-04 00:00:00",
        "Sat, 4 Jul 1998 21:15:09 +0530": "1998-07-04 15:45:09",
        "Sat, 04 Jul 1998 21:15:09 GMT": "1998-07-04 21:15:09",
        "1998-07-04T21:15:09.5": None,
        "1998-06-31": None,
        "Xyz, 04 Jul 1998 21:15:09 GMT": None,
        "next summer": None,
        "": None,
        None: None,
    }
    texts = values(spark, lambda c: fn.parse_date(c).cast("string"), list(cases))
    assert texts == list(cases.values())


def test_feed_dates_with_zone_names(spark):
    cases = {
        "Sat, 04 Jul 1998 21:15:09 EST": "1998-07-05 02:15:09",
        "Sat, 04 Jul 1998 21:15:09 PDT": "1998-07-05 04:15:09",
        "Sat, 04 Jul 1998 21:15:09 UT": "1998-07-04 21:15:09",
        "4 Jul 1998 21:15 Z": "1998-07-04 21:15:00",
        "Sat, 04 Jul 1998 21:15 +0100": "1998-07-04 20:15:00",
        "Sat, 04 Jul 1998 21:15:09 XYZ": None,
        "Sat, 04 Jul 1998 EST": None,
    }
    assert values(spark, lambda c: fn.parse_date(c).cast("string"), list(cases)) == list(cases.values())


def test_scraped_times_keep_their_fraction(spark):
    texts = ["1998-07-04T21:15:09.5", "1998-07-04T21:15:09.123456789Z", "1998-07-04 21:15:09", "21:15:09.5", None]
    shown = values(spark, lambda c: fn.parse_scraped(c).cast("string"), texts)
    assert shown == ["1998-07-04 21:15:09.5", "1998-07-04 21:15:09.123456", "1998-07-04 21:15:09", None, None]


def test_report_date(spark):
    texts = ["1998-07-04T21:15:09Z", "1998-07-04T21:15:09+02:00", "1998-07-04T21:15:09.25", "1998-07-04", "soon", None]
    shown = ["04/07/1998 à 21:15", "04/07/1998 à 19:15", "04/07/1998 à 21:15", "04/07/1998 à 00:00", "soon", ""]
    assert values(spark, fn.format_report_date, texts) == shown


def test_report_date_names_no_day_of_its_own(spark):
    texts = ["12:30:00", "2024", "2024-01", "T12:30", "2024-01-32"]
    assert values(spark, fn.format_report_date, texts) == texts


def test_categories(spark):
    lists = [["Rail", "Bus", "Rail"], [" <i>Bus</i> ", "", None], [], None]
    assert values(spark, fn.normalize_categories, lists, "array<string>") == [["Bus", "Rail"], ["Bus"], [], []]
    landed = ['["Rail","Bus"]', "Night trains", "[Rail] extra", "[]", None]
    parsed = [["Rail", "Bus"], ["Night trains"], ["[Rail] extra"], [], None]
    assert values(spark, fn.parse_categories, landed) == parsed


def test_names(spark):
    names = ["AI & Machine Learning", "--Été_2024!!", "KDnuggets", None]
    assert values(spark, fn.slugify, names) == ["ai-machine-learning", "été_2024", "kdnuggets", None]
    assert values(spark, fn.match_name, [" Hugging-Face_Blog "]) == ["hugging face blog"]
    stems = ["kd3nuggets-it's-MLOps", "hugging-face-blog", "", None]
    assert values(spark, fn.title_case, stems) == [s.replace("-", " ").title() if s is not None else None for s in stems]
