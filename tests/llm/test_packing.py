"""Packing: the pieces against the tokenizer, the places against the definition of a packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm.packing import Encoder, best_fit, pack, ranks_file, sequences


ENCODER = Encoder(ranks_file())
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return TOKENIZER


def check(docs, tokenizer, capacity=1024):
    rows = docs.select("doc_id", "text").collect()
    got = pack(docs, capacity, keep_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = np.array(ids[a:b], "<u4").tobytes()
            want[r.doc_id, i, a, b - a, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == plain_best_fit([r.length for r in got], capacity)
    return got


def plain_best_fit(lengths, capacity):
    """The number of bins of best-fit-decreasing, one item at a time."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_documents(documents, tokenizer):
    got = check(documents, tokenizer)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.03 * total / 1024 + 1


def test_edges(docs_of, tokenizer):
    texts = [None, "", " ", "a", "a", "x y " * 5000, "word " * 1023, "no" * 3000, "a  b\n c \t d  e", "<|endoftext|>"]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|> x <|endoftext|> ", "<|endoftext", "a <|endoftext|>" * 700]
    got = check(docs_of(texts, length=["x"] * len(texts), rank=["y"] * len(texts)), tokenizer)
    assert got
    check(docs_of(["a b c d"] * 200), tokenizer, 7)


def test_repeated_and_null_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)], "doc_id long, text string")
    check(docs, tokenizer)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sequences_hold_the_ids(documents, spark):
    packed = pack(documents, keep_ids=True)
    joined = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    for r in packed.collect():
        assert joined[r.sequence_id][4 * r.offset :][: 4 * r.length] == bytes(r.ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab' \n\t  é.1<|s"), max_size=40))
def test_cutting_at_spaces_changes_no_id(text):
    encoder = ENCODER
    assert encoder.between(text) == encoder.plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "b ", "<|", "\n", "é", "<|endoftext"]), max_size=12).map("".join))
def test_special_tokens_in_texts(text):
    assert ENCODER.ids(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_runs_equal_single_steps(lengths):
    plan = best_fit(Counter(lengths), 30)
    fill = defaultdict(list)
    for run in plan:
        for i in range(run.count):
            fill[run.bin + i // run.per_bin].append((run.offset + i % run.per_bin * run.length, run.length))
    assert Counter(n for parts in fill.values() for _, n in parts) == Counter(lengths)
    for parts in fill.values():
        ends = [0]
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 30
    assert len(fill) == plain_best_fit(lengths, 30)
