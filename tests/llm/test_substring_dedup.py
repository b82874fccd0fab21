"""Repeated passages against a dictionary of all windows."""

import pytest

from newsloom.llm import substring_dedup as module
from newsloom.llm.substring_dedup import drop_repeated_passages


def brute(rows, width=13):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((i, len(words), len(gone), kept))
    return sorted(out)


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = drop_repeated_passages(docs, **options).select("row.doc_id", "n_words", "n_removed", "row.text").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    return got


def test_equals_brute_force(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("flush", [100, 3_000_000])
def test_edges(docs_of, rng, flush, monkeypatch):
    monkeypatch.setattr(module, "FLUSH", flush)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"{' '.join(f'u{k}-{i}' for i in range(rng.randint(0, 30)))} {passage} tail{k}" for k in range(60)]
    texts += [None, "", " \n", "a", "A b", passage, passage, "z " * 30_000, "z " * 40, "é x " * 20, passage.upper()]
    rng.shuffle(texts)
    check(docs_of(texts, doc=["x"] * len(texts), places=["y"] * len(texts)))


def test_many_parts_equal_one(documents, monkeypatch):
    monkeypatch.setattr(module, "LEAST_CELLS", 1000)
    check(documents, most_cells=100_000)


def test_repeated_rows(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, one), (1, two), (2, two), (None, two), (3, one)]
    got = drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r[0] or -1, r[1], r[2]) for r in got.select("row.doc_id", "n_removed", "row.text").collect())
    assert found == [(-1, 0, two), (1, 0, one), (1, 0, one), (1, 30, ""), (2, 30, ""), (3, 30, "")]


def test_empty_table(spark):
    assert drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_input_is_read_as_often_as_a_small_one(documents, monkeypatch):
    """However many parts the sketch has, the texts go through one exchange, and nothing is broadcast."""
    monkeypatch.setattr(module, "LEAST_CELLS", 1000)
    sent = []
    monkeypatch.setattr(type(documents.sparkSession.sparkContext), "broadcast", lambda self, value: sent.append(value))
    plans = [
        drop_repeated_passages(documents, most_cells=most)._jdf.queryExecution().executedPlan().toString()
        for most in (2**29, 20_000)
    ]
    scans = [plan.count("FileScan") for plan in plans]
    assert scans[0] == scans[1] <= 3 and not sent


def test_columns_of_any_type_stay(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = spark.createDataFrame([(1, passage), (2, passage + " x"), (None, None)], "doc_id long, Text string").selectExpr(
        "doc_id", "map('a', array(doc_id)) as m", "Text", "timestamp_ntz'2024-01-31 09:00:00' as t", "cast(1.5 as decimal(9,2)) as d",
        "named_struct('text', 'inner', 'n', null) as s", "date'2024-01-31' as day", "cast('b' as binary) as b",
    )
    got = drop_repeated_passages(rows).orderBy("row.doc_id")
    found = [(r.doc_id, r.Text, r.m, r.t, r.d, r.s, r.day, r.b) for r in got.select("row.*").collect()]
    want = [(r.doc_id, r.m, r.t, r.d, r.s, r.day, r.b) for r in rows.orderBy("doc_id").collect()]
    assert [(f[0], *f[2:]) for f in found] == want
    assert [f[1] for f in found] == ["", passage, "x"]
