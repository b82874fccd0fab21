"""Near-duplicates against all pairs of sets in Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm.near_dedup import near_duplicates
from newsloom.llm.setsketch import REGISTERS, jaccard, registers


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute(rows):
    """Pairs that share a shingle, by an index; then union-find."""
    sets = {i: shingles(text) for i, text in rows}
    having = defaultdict(list)
    for i, s in sets.items():
        for shingle in s:
            having[shingle].append(i)
    pairs = {(a, b) for ids in having.values() for a in ids for b in ids if a < b}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_equals_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_edges_chains_and_strays(docs_of, rng):
    base = [f"w{i}" for i in range(120)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"x{rng.random()}"
        return words

    chain = [base]
    for _ in range(30):
        chain.append(edited(chain[-1], 3))
    stars = [edited(base, rng.randint(1, 6)) for _ in range(80)]
    half = [base[:60] + [f"y{k}-{i}" for i in range(40)] for k in range(20)]
    texts = [" ".join(words) for words in (*chain, *stars, *half)]
    short = ["a b c d", "A  b\tc d", "a b c", "one", "one", "a b c d e f g h", "a b c d e f g h i"]
    texts += [None, "", " \n ", *short, *texts[:5], "z " * 50_000, "z " * 60_000]
    rng.shuffle(texts)
    check(docs_of(texts, band=["x"] * len(texts), a=["y"] * len(texts)))


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "q r s")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in got if r.n_shingles)
    assert kept == [(-1, None, True), (1, None, False), (1, None, False), (7, 7, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n, shared", [(1, 1), (4, 3), (300, 200), (5000, 4000), (5000, 0)])
def test_registers_estimate_similarity(n, shared):
    draw = np.random.default_rng(n)
    elements = draw.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
    left, right = elements[:n], elements[n - shared :]
    owner = np.repeat([0, 1], [n, n])
    values = registers(np.concatenate([left, right]), owner, 2, 4096)
    got = jaccard(values[:1], values[1:], np.array([n]), np.array([n]))[0]
    assert got == pytest.approx(shared / (2 * n - shared), abs=0.05)


def test_registers_of_unions_are_maxima():
    draw = random.Random(1)
    sets = [np.array([draw.getrandbits(64) for _ in range(n)], np.uint64) for n in (3, 40, 700)]
    one = [registers(s, np.zeros(len(s), int), 1)[0] for s in sets]
    union = registers(np.concatenate(sets), np.zeros(743, int), 1)[0]
    assert (np.maximum.reduce(one) == union).all() and len(union) == REGISTERS
