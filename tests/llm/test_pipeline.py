"""Every stage of the pipeline, on what the stage before it left, against plain Python."""

from collections import Counter, defaultdict

import test_near_dedup
import test_packing
import test_quality

import corpus_pipeline
from newsloom.session import written


def lines_left(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\f\r").encode().lower()
            if len(key.decode()) >= 40:
                holders[key].add(i)
    out = {}
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            own = holders.get(line.strip(" \t\n\x0b\f\r").encode().lower(), ())
            if len(own) < 5 or i == max(own):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    source = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    filtered, lined, unique, mixed, packed = (d.collect() for d in seen)

    kept = {i for i, (_, _, keep, _) in test_quality.brute(source).items() if keep}
    assert {r.doc_id for r in filtered} == kept and len(filtered) == len(kept) < len(source)
    assert {r.doc_id: r.text for r in lined} == lines_left([(r.doc_id, r.text) for r in filtered])
    assert all(r.n_chars == len(r.text) for r in lined)
    first = {i for i, (_, _, keep) in test_near_dedup.brute([(r.doc_id, r.text) for r in lined]).items() if keep}
    assert {r.doc_id for r in unique} == first and len(unique) == len(first) < len(lined)
    assert Counter(map(tuple, unique)) == Counter(map(tuple, mixed))
    assert {r.doc_id for r in packed} == first
    lengths = [r.length for r in packed]
    assert len({r.sequence_id for r in packed}) == test_packing.plain_best_fit(lengths, 1024)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_stages_chained_without_writing(spark, docs_of, rng):
    """A stage whose input was not written leaves the tables alone that it still reads; two runs do not mix."""
    texts = [" ".join(rng.choices(["ka", "lo", "mi", "ne", "su", "to", "ra"], k=80)) for _ in range(40)]
    docs = docs_of(texts, lang=["en"] * 40, source=["s"] * 40)
    ends = []
    for write in (False, True):
        found = docs
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, found, "chained")
            found = written(found, name) if write else found
        ends.append(found)
    lazy, eager = ends
    assert Counter(map(tuple, lazy.collect())) == Counter(map(tuple, eager.collect())) and lazy.count() > 0


def test_edges_of_every_stage(spark):
    """NULLs, empty and very long texts, repeated rows and columns with the operators' own names."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
    shared = "\n".join(["a line of more than forty characters that many share"] * 2)
    rows = [(1, None, "en"), (2, "", "en"), (3, long, "en"), (3, long, "en"), (None, shared, None), (None, None, None)]
    rows += [(10 + i, f"{shared}\nown {i}", "en") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "'s' as source", "1 as slot", "'k' as key", "2 as row", "3 as n", "'b' as block"
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "edges").collect()
        assert got == [] or list(got[0].asDict()) == docs.columns
        want = Counter(map(tuple, docs.collect()))
        if name == "source_mixing":
            assert Counter(map(tuple, got)) == want
        elif name == "line_dedup":
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
            left = {r.doc_id: r.text for r in got}
            assert left[17] == f"{shared}\nown 7" and left[10] == "own 0" and left[3] == long
        else:
            assert not Counter(map(tuple, got)) - want
            assert (name == "quality_rules") == (not any(r.text == "" for r in got))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "edges").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)


def test_sequences_follow_the_mixture(spark, rng):
    """Every prefix of the packed sequences has the target shares, until the small source is used up."""
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "ne", "lo", "si", "du")]
    rows = []
    for i in range(2500):
        n = rng.choice((300, 900, 2500))
        rows.append((i, " ".join(rng.choices(words, k=n)), "en", "large" if i < 2000 else "small", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    mixed = written(stages["source_mixing"](spark, docs, ""), "mixed")
    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    bytes_of = {name: sum(len(r[1]) for r in rows if r[3] == name) for name in ("large", "small")}
    target = bytes_of["small"] ** 0.5 / sum(n**0.5 for n in bytes_of.values())
    order = sorted(packed, key=lambda r: (r.sequence_id, r.offset))
    n_sequences = order[-1].sequence_id + 1
    assert {r.sequence_id for r in order} == set(range(n_sequences))
    assert n_sequences == test_packing.plain_best_fit([r.length for r in order], 1024)
    total = sum(r.length for r in order)
    held = {"large": 0, "small": 0}
    for r in order:
        held["large" if r.doc_id < 2000 else "small"] += r.length
        done = sum(held.values())
        if 0.3 * total < done < 0.5 * total:
            assert abs(held["small"] / done - target) < 0.08, (done / total, held)
