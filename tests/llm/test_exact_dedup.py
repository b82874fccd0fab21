"""Exact deduplication against a dictionary, with colliding hashes too."""

import hashlib
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm.exact_dedup import content_hash, exact_groups

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, choose):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for i, text in rows:
        body = (text or "").translate(LOWER)
        keep = choose((x for x in groups[body] if x is not None), default=None)
        out.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


HASHES = {"md5": content_hash, "length": lambda t: F.length(t), "constant": lambda t: F.lit(1)}


@pytest.mark.parametrize("hash_name", HASHES)
@pytest.mark.parametrize("keep", ["min", "max"])
def test_edges_and_collisions(spark, hash_name, keep):
    rows = [(1, "ab"), (2, "AB"), (3, "ac"), (4, "ÄB"), (5, "äB"), (6, None), (7, ""), (8, " "), (9, "x" * 200_000)]
    rows += [(10, "X" * 200_000), (11, "y" * 200_000), (2, "AB"), (2, "zz"), (None, "ab"), (None, "only"), (12, "ac")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'h' as hash")
    got = exact_groups(docs, keep=getattr(F, keep), hash_of=HASHES[hash_name]).collect()
    want = brute(rows, {"min": min, "max": max}[keep])
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
