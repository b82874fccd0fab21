"""Landed files: JSON arrays of differing keys, feed documents."""

import json
import pathlib
from datetime import datetime

from pyspark.sql import functions as F

from newsloom.operators.match import match_feeds
from newsloom.operators.normalize import entry_to_raw, normalize_articles
from newsloom.session import scratch_dir
from newsloom.sources import (
    atom_entries,
    broken_articles,
    newest_first,
    read_articles,
    read_atom,
    read_feed_list,
    read_rss,
    rss_entries,
    write_articles,
    write_by_source,
)


def test_read_json_arrays(spark, tmp_path):
    first = [{"title": "A", "url": "u1", "categories": ["x", "y"]}, {"title": "B", "content": "c", "date": "2024-01-02"}]
    second = [{"title": "C", "categories": "single", "source": "given", "date": "2024-01-03"}]
    (tmp_path / "hugging-face-blog.json").write_text(json.dumps(first, indent=2))
    (tmp_path / "openai.json").write_text(json.dumps(second))
    (tmp_path / "normalized_articles.json").write_text(json.dumps([{"title": "N"}]))
    rows = {r.title: r for r in read_articles(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert (rows["A"].categories, rows["B"].categories, rows["C"].categories) == (["x", "y"], None, ["single"])
    assert (rows["B"].url, rows["B"].content, rows["C"].source) == (None, "c", "given")
    tagged = {r.title: r.source for r in read_articles(spark, str(tmp_path), tag="source").collect()}
    assert tagged == {"A": "hugging-face-blog", "B": "hugging-face-blog", "C": "openai"}
    titled = {r.title: r.source_name for r in read_articles(spark, str(tmp_path), tag="source_name").collect()}
    assert titled["A"] == "Hugging Face Blog"
    everything = read_articles(spark, str(tmp_path), exclude=())
    assert everything.count() == 4
    ordered = [r.title for r in newest_first(read_articles(spark, str(tmp_path))).collect()]
    assert ordered == ["C", "B", "A"]


def test_write_by_source_replaces_only_what_it_holds(spark):
    path = scratch_dir(spark, "out")
    schema = "title string, source string"
    write_by_source(spark.createDataFrame([("1", "Été Blog"), ("2", "B")], schema), path)
    write_by_source(spark.createDataFrame([("3", "B")], schema), path)
    rows = read_articles(spark, path, json_lines=True, tag="source").collect()
    assert {(r.title, r.source) for r in rows} == {("1", "été-blog"), ("3", "b")}


def test_written_json_takes_a_fraction_of_its_text(spark, tmp_path):
    """What is landed and normalised is compressed, and read back whole, lines in their order."""
    text = "words of a text that are not all the same, such as "
    rows = spark.range(0, 3000, 1, 1).selectExpr(
        "concat('T', id) as title", f"concat(repeat('{text}', 5), id) as content", "concat('s', id % 3) as source"
    )
    plain = 3000 * 5 * len(text)
    landed, normal = str(tmp_path / "landed"), str(tmp_path / "normal")
    write_by_source(rows, landed)
    write_articles(rows, normal)
    for path in (landed, normal):
        files = [file for file in pathlib.Path(path).rglob("part-*")]
        assert 0 < sum(file.stat().st_size for file in files) < plain / 2  # it was more than all of it
        back = read_articles(spark, path, json_lines=True, with_place=True)
        assert sorted(tuple(r) for r in back.select("title", "content", "source").collect()) == sorted(
            tuple(r) for r in rows.collect()
        )
    placed = read_articles(spark, normal, json_lines=True, with_place=True).orderBy("seq").collect()
    assert [r.title for r in placed] == [f"T{i}" for i in range(3000)]


def test_second_write_shuffles_texts_once(spark, sf_dir, monkeypatch):
    """The query finds the sources to replace by broadcast; their texts go through the writer's exchange only."""
    from newsloom.catalog import files as catalog

    written_plans = []
    write = catalog.files.write_by_source

    def recorded(articles, path):
        written_plans.append(articles._jdf.queryExecution().executedPlan().toString())
        write(articles, path)

    monkeypatch.setattr(catalog.files, "write_by_source", recorded)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the texts here, more than the sources
    try:
        catalog.write_by_source(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(written_plans) == 2 and "BroadcastHashJoin" in written_plans[1]
    assert "hashpartitioning(source" not in written_plans[1]  # it was a sort-merge join


def test_feed_list(spark, tmp_path):
    feeds = [{"name": f"f{i}", "url": f"https://f/{i}"} for i in range(5)]
    (tmp_path / "feeds.json").write_text(json.dumps(feeds, indent=1))
    rows = read_feed_list(spark, str(tmp_path / "feeds.json")).orderBy("seq").collect()
    assert [r.name for r in rows] == [f["name"] for f in feeds]


RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" version="2.0">
<channel><title>Feed</title>
<item><title>One &amp; only</title><link>https://a.com/1</link><description><![CDATA[<p>Sum</p>]]></description>
<content:encoded><![CDATA[<p>Whole &amp; text</p>]]></content:encoded><dc:creator>Ann</dc:creator>
<category>AI</category><category domain="x">ML</category><pubDate>Tue, 30 Jan 2024 10:00:00 +0200</pubDate></item>
<item><title>Two</title><link>https://a.com/2</link></item>
</channel></rss>"""

ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><title>One</title><link rel="self" href="https://a.com/self"/><link rel="alternate" href="https://a.com/1"/>
<summary>Sum</summary><content type="html">&lt;p&gt;Whole&lt;/p&gt;</content><author><name>Ann</name></author>
<category term="AI"/><category term="ML"/><updated>2024-01-30T10:00:00Z</updated></entry>
<entry><title>Two</title><link href="https://a.com/2"/><published>2024-01-29T10:00:00Z</published><updated>2024-01-30T10:00:00Z</updated></entry>
</feed>"""


def test_rss(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    one, two = rss_entries(read_rss(spark, str(tmp_path))).orderBy("title").collect()
    assert (one.title, one.link, one.summary) == ("One & only", "https://a.com/1", "<p>Sum</p>")
    assert (one.content, one.author) == ("<p>Whole &amp; text</p>", "Ann")
    assert one.categories == ["AI", "ML"]
    assert one.published == "Tue, 30 Jan 2024 10:00:00 +0200"
    assert (two.link, two.content, two.categories, two.published) == ("https://a.com/2", None, None, None)


def test_atom(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(ATOM)
    one, two = atom_entries(read_atom(spark, str(tmp_path))).orderBy("title").collect()
    assert (one.link, one.summary, one.content) == ("https://a.com/1", "Sum", "<p>Whole</p>")
    assert (one.author, one.categories, one.published) == ("Ann", ["AI", "ML"], "2024-01-30T10:00:00Z")
    assert (two.link, two.published) == ("https://a.com/2", "2024-01-29T10:00:00Z")


def test_landed_files_as_the_scraper_writes_them(spark, tmp_path):
    """Arrays, content in every shape, times with fractions, broken files and normalised folders."""
    (tmp_path / "a.json").write_text(
        """[{"title":"list","content":[{"value":"one"},{"value":"two"}],"scraped_at":"2024-01-31T09:00:00.123456"},
        {"title":"object","content":{"value":"three"}}, {"title":"text","content":"[four"},
        {"title":"encoded","content":"","content_encoded":"five"}, {"title":"none"}]"""
    )
    (tmp_path / "b.json").write_text('[{"title":"cut of')
    write_articles(spark.createDataFrame([("normal",)], "title string"), f"{tmp_path}/normalized_articles.json")
    raw = read_articles(spark, str(tmp_path))
    assert {r.title: r.content for r in raw.collect()} == {
        "list": "one", "object": "three", "text": "[four", "encoded": "five", "none": None,
    }
    assert raw.count() == 5
    moments = [r.scraped_at for r in normalize_articles(raw).filter("title = 'list'").collect()]
    assert moments == [datetime(2024, 1, 31, 9, 0, 0, 123456)]
    (broken,) = broken_articles(spark, str(tmp_path)).collect()
    assert broken.file.endswith("/b.json") and broken.record.startswith("[{") and broken.reason == "not valid JSON"


def test_places_in_files_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"title":"3"}\n{"title":"4"}\n')
    (tmp_path / "a.json").write_text('{"title":"1"}\n{"title":"2"}\n')
    raw = read_articles(spark, str(tmp_path), json_lines=True, with_place=True)
    assert [r.title for r in normalize_articles(raw).orderBy("seq").collect()] == ["1", "2", "3", "4"]


def test_places_in_arrays_do_not_depend_on_splits_or_partitions(spark, tmp_path):
    """Several files, read with small and large splits: the same places, and their order is that of the files."""
    for name, size in (("b", 3), ("a", 40), ("c", 1)):
        rows = [{"title": f"{name}{i}", "url": f"https://a.com/{name}/{i}", "content": "x" * 500} for i in range(size)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "d.json").write_text('{"title":"one object"}')
    found = []
    for split in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = read_articles(spark, str(tmp_path), with_place=True).select("title", "seq").orderBy("seq").collect()
        found.append([(r.title, r.seq.file[-6:], r.seq.row) for r in rows])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1]
    assert [title for title, _, _ in found[0]] == [f"a{i}" for i in range(40)] + ["b0", "b1", "b2", "c0", "one object"]
    assert [row for _, file, row in found[0] if file == "a.json"] == list(range(40))


def test_feed_lists_of_several_files_apply_in_order(spark, tmp_path):
    (tmp_path / "2.json").write_text('[{"name":"c","url":"u2"},{"name":"a","url":"late"}]')
    (tmp_path / "1.json").write_text('[{"name":"b","url":"u1"},{"name":"a","url":"first"},{"other":1}]')
    (tmp_path / "3.json").write_text("no list")
    rows = read_feed_list(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.name, r.url) for r in rows] == [("b", "u1"), ("a", "first"), ("c", "u2"), ("a", "late")]
    sources = spark.createDataFrame([("A",)], "source string")
    assert match_feeds(sources, read_feed_list(spark, str(tmp_path))).first().feed_url == "first"


RICH_RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>1</title><guid>https://a.com/1</guid><dc:date>2024-01-30T10:00:00Z</dc:date><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator></item>
<item><title>2</title><guid isPermaLink="false">https://a.com/no</guid><author>Cleo</author><dc:creator>Dan</dc:creator></item>
<item><title>3</title><guid isPermaLink="true">https://a.com/no</guid><link>https://a.com/3</link><pubDate>30 Jan 2024 10:00 EST</pubDate></item>
<item><title>4</title><link> </link><guid> https://a.com/4 </guid><description><p>in <b>markup</b></p></description><author> </author></item>
</channel></rss>"""

RICH_ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>https://a.com/1</id><title type="xhtml"><div>One <i>and</i></div></title><author><name>Ann</name><email>a@a.com</email></author>
<author><name>Bob</name></author><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Whole <b>text</b> &amp; more</p></div></content></entry>
<entry><id>urn:2</id><title>Two</title><link href="https://a.com/2"/><content type="video/mp4" src="https://a.com/v"/></entry>
</feed>"""


def test_feed_items_in_all_their_forms(spark, tmp_path):
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "f.xml").write_text(RICH_RSS)
    rows = rss_entries(read_rss(spark, str(tmp_path / "rss"))).orderBy("title").collect()
    assert [r.link for r in rows] == ["https://a.com/1", None, "https://a.com/3", "https://a.com/4"]
    assert [r.author for r in rows] == ["Ann, Bob", "Cleo", None, None]
    assert [r.published for r in rows] == ["2024-01-30T10:00:00Z", None, "30 Jan 2024 10:00 EST", None]
    assert rows[3].summary == "<p>in <b>markup</b></p>"
    (tmp_path / "atom").mkdir()
    (tmp_path / "atom" / "f.xml").write_text(RICH_ATOM)
    entries = atom_entries(read_atom(spark, str(tmp_path / "atom")))
    one, two = entries.orderBy("published", "link").collect()
    assert (one.link, one.author) == ("https://a.com/1", "Ann, Bob")
    assert one.content == '<div xmlns="http://www.w3.org/1999/xhtml"><p>Whole <b>text</b> & more</p></div>'
    assert (two.link, two.content, two.author) == ("https://a.com/2", None, None)
    cleaned = normalize_articles(entry_to_raw(entries, "2024-01-31", F.lit("A"))).orderBy("url").collect()
    assert [r.content for r in cleaned] == ["Whole text & more", None]
    assert cleaned[0].title == "One and"
