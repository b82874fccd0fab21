"""Centroid clustering against plain integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import centroids
from newsloom.llm.centroids import _Centroids, cluster_vectors


def brute(rows, clusters, rounds, size, scale):
    kept = [
        (i, [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v], v)
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centres = [v for _, v, _ in named[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            groups[nearest(v)[1]].append(v)
        for j, own in groups.items():
            centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *reversed(nearest(v))) for i, v, _ in kept]
    inertia = defaultdict(int)
    for _, j, d in found:
        inertia[j] += d

    def fits(x):
        return x if x < 2**63 else None

    return [
        (i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
        for i, j, d in found
    ]


def check(spark, rows, clusters=4, rounds=3, size=3, scale=8, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' as near", "1 as cluster")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = cluster_vectors(df.repartition(3), clusters, rounds, size, scale).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, clusters, rounds, size, scale), key=repr)


@pytest.mark.parametrize("spread", [0.2, 3])
def test_equals_plain_integers(spark, spread):
    rng = random.Random(3)
    middles = [[rng.uniform(-9, 9) for _ in range(3)] for _ in range(7)]
    rows = [(i, [rng.gauss(x, spread) for x in rng.choice(middles)]) for i in range(600)]
    check(spark, rows, clusters=9)


def test_ties_repeats_and_vectors_that_do_not_count(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.0]) for i in range(30)]
    odd = [(40, None), (41, []), (42, [1.0, 2.0]), (43, [1.0, 2.0, None]), (44, [math.nan, 0.0, 0.0]), (45, [math.inf, 0.0, 0.0])]
    check(spark, grid + grid[:5] + odd + [(None, [5.0, 5.0, 5.0]), (None, [4.0, 5.0, 5.0])])


@pytest.mark.parametrize("largest", [1e7, 1e12, 1e300])
def test_numbers_beyond_64_bits(spark, largest):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * largest for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    check(spark, rows, kind="double")


def test_few_vectors_and_none(spark):
    check(spark, [(1, [1.0, 2.0, 3.0])])
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, -3.0])], rounds=0)
    check(spark, [(1, [1.0, 2.0])])
    check(spark, [])


def test_search_from_any_state_and_pruning(monkeypatch):
    """Whatever two centroids a vector remembers, the nearest is found; in the rounds after, few distances are computed."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-400, 400, (24, 8))
    rows = middles[rng.integers(0, 24, 3000)] + rng.integers(-20, 20, (3000, 8))
    first = [list(map(int, c)) for c in rows[:24]]
    near = rng.integers(0, 24, 3000)
    second = (near + rng.integers(1, 24, 3000)) % 24
    computed = []
    plain = centroids._squared
    monkeypatch.setattr(centroids, "_squared", lambda x, c: computed.append(len(x)) or plain(x, c))
    state = near, second, np.zeros(3000)
    before = None
    for centres in (first, [[x + 1 for x in c] for c in first]):
        computed.clear()
        *state, best = _Centroids(centres, before).nearest(rows, *state)
        d = ((rows[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        before = centres
    assert sum(computed) < 3000 * 24 / 8  # all: 3000 * 24
