"""The digest and report documents, letter by letter."""

from datetime import datetime

from newsloom.plans import digest, report
from newsloom.session import scratch_dir, written
from newsloom.sources import latest_digest, write_digest, write_full_list

AS_OF = "2024-01-31 09:00:00"
SCHEMA = "id long, title string, url string, source_name string, date timestamp, summary string, content string"


def page(spark):
    return spark.createDataFrame(
        [
            (1, "One", "https://a/1", "A", datetime(2024, 1, 30), "s" * 60, "c"),
            (2, "Two", "https://b/2", "B", datetime(2024, 1, 31), "", "c" * 2001),
            (3, "Three", "https://a/3", "A", datetime(2024, 1, 30), "short", "short"),
        ],
        SCHEMA,
    )


BODY_A = "\n".join(
    [
        "\n## Articles de A (2 articles)",
        "\n### [One](https://a/1) - 30/01/2024",
        "Résumé : " + "s" * 60,
        "\n### [Three](https://a/3) - 30/01/2024",
    ]
)
BODY_B = "\n".join(
    [
        "\n## Articles de B (1 articles)",
        "\n### [Two](https://b/2) - 31/01/2024",
        "Contenu : " + "c" * 2000 + "...",
    ]
)


def test_blocks(spark):
    blocks = {r.source: (r.n_articles, r.body) for r in digest.digest_blocks(page(spark)).collect()}
    assert blocks == {"A": (2, BODY_A), "B": (1, BODY_B)}


def test_request_orders_sources_by_first_appearance(spark):
    rows = digest.digest_requests(page(spark), AS_OF, template="{period}|{content}|{x}").orderBy("position").collect()
    span = "24/01/2024 au 31/01/2024"
    assert [r.request for r in rows] == [f"{span}|{BODY_B}|" + "{x}", f"{span}|{BODY_A}|" + "{x}"]
    assert digest.digest_requests(page(spark).filter("id > 9"), AS_OF).count() == 0


def test_slices_keep_every_article(spark):
    rows = spark.range(95).selectExpr(
        "id", "concat('T', id) as title", "'https://a/' || id as url", "'A' as source_name",
        "timestamp'2024-01-30' as date", "'' as summary", "'' as content",
    )
    blocks = digest.digest_blocks(rows, slice_articles=10).orderBy("slice").collect()
    assert [r.slice for r in blocks] == list(range(10)) and {r.n_articles for r in blocks} == {95}
    assert "".join(r.body for r in blocks).count("### [") == 95 and blocks[0].body.count("## Articles de A (95") == 1
    requests = digest.digest_requests(rows, AS_OF, template="<{content}>", slice_articles=10)
    last = digest.generate_digest(requests, lambda: list, AS_OF, template="<{content}>", fan_in=3).first().digest
    # Ten answers, joined by three, then by two, then one: all articles in order.
    assert [int(part.split("]")[0]) for part in last.split("### [T")[1:]] == list(range(95))
    assert last.count("<") == 10 + 4 + 2 + 1


def test_one_request_joins_all_answers(spark):
    requests = spark.range(1, 121).selectExpr("id as position", "'A' as source", "0 as slice", "'T' || id as request")
    text = digest.generate_digest(requests, lambda: list, AS_OF, template="<{content}>").first().digest
    assert text.endswith("\n\n<" + "\n".join(f"T{i}" for i in range(1, 121)) + ">") and text.count("<") == 1


def test_generated_digest_and_short_answer(spark):
    requests = digest.digest_requests(page(spark), AS_OF)
    good = digest.generate_digest(requests, lambda: lambda texts: ["x" * 50 for _ in texts], AS_OF).first()
    assert good.digest == "# Veille IA: Résumé hebdomadaire du 24/01/2024 au 31/01/2024\n\n" + "x" * 50
    bad = digest.generate_digest(requests, lambda: lambda texts: ["no" for _ in texts], AS_OF).first()
    assert bad.digest == "# Erreur de génération du résumé\n\nAucune réponse de qualité générée. Réponse reçue: no"


def test_answers_move_in_pieces(spark, monkeypatch):
    """No step but the model has a whole answer, and the digest is the same, one by one, joined, and as a file."""
    tables = []
    monkeypatch.setattr(digest, "written", lambda df, *more: tables.append(written(df, *more)) or tables[-1])
    monkeypatch.setattr(digest, "PIECE", 100, raising=False)
    texts = [f"T{i}\n\n" + f"line {i} é\n" * (i % 9) * 5 + ("" if i % 4 else "\n\n") for i in range(40)] + ["x" * 150, " ", ""]
    requests = spark.createDataFrame(list(enumerate(texts, 1)), "position long, request string").repartition(3)
    answers = [text if text.strip() else "" for text in texts]

    def joined(texts):
        return "<" + "\n".join(texts) + "|24/01/2024 au 31/01/2024>"

    head = "# Veille IA: Résumé hebdomadaire du 24/01/2024 au 31/01/2024\n\n"
    for fan_in, want in ((None, joined(answers)), (7, joined([joined(answers[i : i + 7]) for i in range(0, 43, 7)]))):
        found = digest.generate_digest(requests, lambda: list, AS_OF, template="<{content}|{period}>", fan_in=fan_in)
        assert [tuple(r) for r in found.collect()] == [("24/01/2024 au 31/01/2024", head + want)]
        pieces = digest.digest_pieces(requests, lambda: list, AS_OF, template="<{content}|{period}>", fan_in=fan_in)
        path = scratch_dir(spark, "digests")
        write_digest(pieces, path, AS_OF)
        assert latest_digest(spark, path).first().content == head + want
    twice = digest.generate_digest(requests, lambda: list, AS_OF, template="{content}{period}{content}").first().digest
    assert twice == head + "24/01/2024 au 31/01/2024".join(["\n".join(answers)] * 2)
    assert digest.generate_digest(requests.limit(0), lambda: list, AS_OF).count() == 0
    lengths = [max(len(r.text) for r in t.select(t.columns[-1]).toDF("text").collect()) for t in tables if t.count()]
    assert lengths and max(lengths) <= 300


def test_full_list(spark):
    target = write_full_list(digest.full_article_list(page(spark)), scratch_dir(spark, "list"), AS_OF)
    parts = spark.read.text(target, wholetext=True).select("value", "_metadata.file_name").orderBy("file_name")
    text = "".join(r.value for r in parts.collect())
    assert text.startswith(
        "# Articles scrappés de la semaine (3)\n\n"
        "## 1. [Two](https://b/2)\n**Date :** 2024-01-31T00:00:00\n\n**Source :** B\n\n**Contenu :**\n\ncccc"
    )
    assert text.endswith(
        "## 3. [Three](https://a/3)\n**Date :** 2024-01-30T00:00:00\n\n**Source :** A\n\n"
        "**Résumé :** short\n\n**Contenu :**\n\nshort\n\n---\n\n"
    )


def test_latest_digest_is_the_file_changed_last(spark):
    path = scratch_dir(spark, "digests")
    for day, text in (("2024-02-05", "late name"), ("2024-01-31", "written last\n\nwith lines")):
        write_digest(spark.createDataFrame([(text,)], "digest string"), path, day)
    row = latest_digest(spark, path).first()
    assert (row.name, row.content) == ("digest_hebdo_20240131", "written last\n\nwith lines")


def test_counters_and_newest_rows(spark):
    rows = page(spark).union(
        spark.createDataFrame(
            [(4, None, None, None, datetime(2024, 1, 23, 9, 0, 1), None, ""), (5, "f", "u", "A", datetime(2030, 1, 1), "", "")],
            SCHEMA,
        )
    )
    counts = report.report_counters(rows, AS_OF).first()
    assert (counts.total_articles, counts.n_sources, counts.this_week) == (5, 3, 5)
    assert sorted(r.source for r in report.report_sources(rows, AS_OF).collect()) == ["A", "B", "Unknown"]
    week_old = report.report_counters(rows, "2024-01-31 09:00:01").first()
    assert week_old.this_week == 4
    shown = report.newest_report_rows(rows, shown=5).collect()
    assert [r.id for r in shown] == [5, 2, 1, 3, 4]
    assert (shown[4].title, shown[4].url, shown[4].source, shown[4].date_shown) == (
        "Sans titre", "#", "Unknown", "23/01/2024 à 09:00",
    )
    assert shown[4].summary == "Aucun résumé disponible"
