"""Line deduplication against plain Python, with hashes spread over many partitions."""

import zlib

import numpy as np
import pytest
from test_pipeline import lines_left

from newsloom.llm.line_dedup import drop_repeated_lines, line_bitmaps


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = lines_left(rows)
    got = drop_repeated_lines(docs).select("row.doc_id", "row.text", "n_lines", "n_dropped").collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        left = want[r.doc_id]
        n_lines = (texts[r.doc_id] or "").count("\n") + 1
        assert (r.text or "", r.n_lines) == (left, n_lines)
        n_left = left.count("\n") + 1 if left or r.n_dropped < n_lines else 0
        assert r.n_lines - r.n_dropped == n_left


def test_documents(documents):
    check(documents)


@pytest.mark.parametrize("partitions", [1, 13, 60])
def test_hot_line_over_partitions(spark, docs_of, rng, partitions):
    hot, four = "a very common line, longer than forty characters", "a line that only four documents have, also long"
    texts = []
    for i in range(300):
        lines = [f"  {hot.upper()}\t" if rng.random() < 0.5 else hot for _ in range(rng.randint(0, 3))]
        lines += [four] * (i < 4) + [f"line {rng.randint(0, 40)} of a set of lines that are repeated now and then"]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", hot, "é" * 39, "É" * 40, *["ß" * 40] * 5, "z" * 100_000, *[f"{hot}\n" * 5000]]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(docs_of(texts, doc=["x"] * len(texts), at=["y"] * len(texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_bitmaps_say_which_lines_stay(docs_of):
    line = "this line is found in all of the five documents"
    docs = docs_of([f"first {i}\n{line}\nlast" for i in range(5)])
    got = {r.doc: np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=r.n_lines) for r in line_bitmaps(docs).collect()}
    assert {i: list(bits) for i, bits in got.items()} == {i: [1, 0, 1] for i in range(4)}


def test_repeated_rows_and_missing_ids(spark):
    line = "this line is found in all of the five documents"
    rows = [(i, line) for i in (1, 1, 2, 3, 4, None)] + [(4, f"{line}\nmore")]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r[0] or -1, r[1], r[2]) for r in got.select("row.doc_id", "row.text", "n_dropped").collect())
    assert found == [(-1, "", 1), (1, "", 1), (1, "", 1), (2, "", 1), (3, "", 1), (4, line, 0), (4, f"{line}\nmore", 0)]


def test_empty_table(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
