"""Mixing: shares at every slot against the targets, and the rows against a plain simulation."""

import math
import random
from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.mixing import SHARES, integer_weights, mix, mix_slots, schedule


def served(blocks, weights):
    """Of the ideal mixture, phase by phase: (start, end, what each source has at the start, its rate)."""
    have, t, phases = {name: Fraction(0) for name in blocks}, Fraction(0), []
    while left := [name for name in blocks if have[name] < blocks[name]]:
        flow = sum(weights[name] for name in left)
        rate = {name: Fraction(weights[name], flow) for name in left}
        end = t + min((blocks[name] - have[name]) / rate[name] for name in left)
        phases.append((t, end, dict(have), rate))
        have |= {name: have[name] + (end - t) * rate[name] for name in left}
        t = end
    return phases


def check_lags(rows, blocks, weights, every=1):
    """At every slot each source is less than one block from the ideal mixture, and each block in its window."""
    phases, had, at = served(blocks, weights), defaultdict(int), 0
    for slot, (name, k, got, release, deadline) in enumerate(rows):
        assert got == slot and had[name] == k and release <= slot < deadline
        had[name] += 1
        while phases[at][1] < slot + 1:
            at += 1
        start, _, have, rate = phases[at]
        if slot % every == 0:
            for other in blocks:
                ideal = have[other] + (slot + 1 - start) * rate.get(other, 0)
                assert abs(had[other] - ideal) < 1
    assert had == blocks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_one_period(values):
    weights = {f"s{i}": w for i, w in enumerate(values)}
    check_lags(schedule(weights, weights), weights, weights)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 60)), min_size=1, max_size=6))
def test_phases(pairs):
    """Sources that are used up leave their share to the others."""
    weights = {f"s{i}": w for i, (w, _) in enumerate(pairs)}
    blocks = {f"s{i}": n for i, (_, n) in enumerate(pairs)}
    check_lags(schedule(blocks, weights), blocks, weights)


def simulated(blocks, weights):
    """Earliest deadline first once more: at every slot, all blocks that have been released are looked at."""
    phases = served(blocks, weights)

    def time(name, k):
        for start, end, have, rate in phases:
            if name in rate and k <= have[name] + (end - start) * rate[name]:
                return start + (k - have[name]) / rate[name]

    order = sorted(blocks, key=lambda name: (-weights[name], name))
    nth, rows = {name: 0 for name in blocks}, []
    for slot in range(sum(blocks.values())):
        ready = []
        for i, name in enumerate(order):
            if nth[name] < blocks[name] and (release := math.floor(time(name, nth[name]))) <= slot:
                ready.append((math.ceil(time(name, nth[name] + 1)), i, name, release))
        deadline, _, name, release = min(ready)
        rows.append((name, nth[name], slot, release, deadline))
        nth[name] += 1
    return rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 25)), min_size=1, max_size=6))
def test_equals_a_plain_simulation(pairs):
    weights = {f"s{i}": w for i, (w, _) in enumerate(pairs)}
    blocks = {f"s{i}": n for i, (_, n) in enumerate(pairs)}
    assert list(schedule(blocks, weights)) == simulated(blocks, weights)


def test_rows_of_documents_equal_the_simulation(spark):
    """Blocks of one document each: the query's rows are those of the plain simulation."""
    counts = {"a": 40, "b": 9, "c": 1, "d": 16}
    rows = [(i, "x" * 100, name) for i, name in enumerate(n for n, k in counts.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_slots(docs, block_bytes=100).select("source", "block", "slot", "release", "deadline").collect()
    weights = integer_weights({name: (100 * n) ** 0.5 for name, n in counts.items()})
    assert sorted(map(tuple, got), key=lambda r: r[2]) == simulated(counts, weights)


def test_documents(documents):
    size = 20_000
    rows = mix_slots(documents, block_bytes=size).collect()
    sizes = {r.doc_id: len((r.text or "").encode()) for r in documents.collect()}
    assert sorted(r.doc for r in rows) == sorted(sizes)
    held = defaultdict(int)
    for r in rows:
        held[r.source] += sizes[r.doc]
        assert r.release <= r.slot < r.deadline
    for source, total in held.items():
        own = sorted((r.block, r.slot) for r in rows if r.source == source)
        assert own[-1][0] <= (total - 1) // size
        assert [s for _, s in own] == sorted(s for _, s in own)
    assert len({(r.source, r.slot) for r in rows}) == len({r.slot for r in rows})


def test_edges(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, "x"), (2, "", "x"), (3, "b" * 5000, "y"), (3, "c", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'s' as slot", "1 as doc")
    got = mix(docs, {"x": 3, "y": 1}, block_bytes=100)
    assert sorted(map(repr, (tuple(r)[:3] for r in got.select("row.*").collect()))) == sorted(map(repr, rows))
    assert got.select("row.*").columns == docs.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0


def test_many_sources(spark):
    """A source per site, most of them with one block: nothing is left out."""
    many = spark.range(6000).selectExpr("id as doc_id", "repeat('a', 100) as text", "string(id % 5000) as source")
    rows = mix_slots(many, block_bytes=100).select("source", "slot").collect()
    assert sorted(r.slot for r in rows) == list(range(6000)) and len({r.source for r in rows}) == 5000


def test_lags_of_many_skewed_sources():
    rng = random.Random(2)
    blocks = {f"s{i}": rng.choice([1, 1, 2, 30]) for i in range(150)} | {"large": 2000}
    weights = integer_weights({name: n**0.5 * rng.uniform(0.5, 2) for name, n in blocks.items()})
    check_lags(schedule(blocks, weights), blocks, weights, every=7)


def test_targets_not_their_rounding():
    """Skewed targets over as many blocks as 30 GB have: no source drifts from its exact share."""
    targets = {f"s{i}": 1.7**-i for i in range(20)} | {"small": 0.0002}
    blocks = {name: 100_000 if name != "s0" else 12_000 for name in targets}
    total, had, t = sum(targets.values()), defaultdict(int), 0
    assert SHARES > 2**30
    for name, *_ in schedule(blocks, integer_weights(targets)):
        had[name] += 1
        t += 1
        if t % 97 == 0:
            assert all(abs(had[name] - t * w / total) < 1.001 for name, w in targets.items())
        if had["s0"] == 11_999:
            break
    assert t > 25_000
