"""The join on shared n-grams against all pairs of sets in Python."""

import random
from collections import defaultdict

import pytest

from newsloom.llm import ngram_join
from newsloom.llm.ngram_join import similar_documents


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute(rows, percent, width):
    """Rows with one id are one document; all pairs of sets, then union-find."""
    sets = [shingles(text, width) for _, text in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (a, _) in enumerate(rows):
        for y, (b, _) in enumerate(rows[:x]):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                low, high = sorted((top(a), top(b)), key=lambda i: (i is not None, i))
                parent[high] = low
    return [(a, len(s), top(a)) for (a, _), s in zip(rows, sets)]


def check(spark, rows, percent=80, width=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as row", "2L as col")
    got = similar_documents(df.repartition(3), width, percent).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, percent, width), key=repr)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in {"BLOCK_ENTRIES": 500, "SHARD_ENTRIES": 400, "PARTNERS": 3, "GROWTH": 2}.items():
        monkeypatch.setattr(ngram_join, name, value)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.random()}"
    return words


def test_near_copies_chains_and_shared_passages(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    rows, texts = [], [" ".join(base)] * 4
    texts += [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(40)]
    # A chain: each is similar to the next only.
    words = base
    for _ in range(12):
        words = edited(rng, words, 3)
        texts.append(" ".join(words).upper())
    # Documents of common passages in different orders share columns, most of them without being similar.
    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(6)]
    texts += [" ".join(rng.sample(passages, rng.randint(1, 5))) for _ in range(60)]
    texts += [" ".join(f"u{i}_{k}" for k in range(30)) for i in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    check(spark, rows)
    check(spark, rows, percent=50, width=3)


def test_at_the_threshold(spark):
    # Sets of k and k + 1 shingles: 4 of 5 is a link, 3 of 4 is none.
    rows = [(i, " ".join(f"a{k}" for k in range(n))) for i, n in enumerate([8, 9, 7, 6, 5, 4, 3])]
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (8, "A b\tc\nd e")]
    rows += [(9, "a a a a a a a a a a"), (10, "a a a a a a"), (11, long), (12, long + " end"), (13, "É b c d e"), (14, "é b c d e")]
    rows += [(15, "a b c d e f"), (5, "one"), (6, "other words here"), (16, "OTHER words here"), (-3, "one two")]
    rows += [(None, "no id at all here"), (None, "a b c d e"), (17, "no id at all here")]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, None)])
