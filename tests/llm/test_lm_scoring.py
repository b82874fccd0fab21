"""Base scores exactly; the suffix tree as a distribution, and by its gain on held-out documents."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from newsloom.llm import lm_scoring as module
from newsloom.llm.lm_scoring import score_texts

CLASSES = END = 256  # symbols of the dense form before its end


def next_level(counts, sequences, least):
    """Contexts one longer that occur ``least`` times, with the index of the context they extend."""
    index = {sequence: i for i, sequence in enumerate(sequences)}
    longer, parents = [], []
    for i, symbol in zip(*np.nonzero(counts >= least)):
        sequence = (*sequences[i], int(symbol))
        if symbol != END and sequence[1:] in index:
            longer.append(sequence)
            parents.append(index[sequence[1:]])
    return longer, parents


def smoothed(counts, parents, parent_counts, parent_p):
    """The distributions of the contexts of one length, as the docstring of ``score_texts`` has them."""
    n = counts.sum(axis=1, keepdims=True)
    different = (counts > 0).sum(axis=1, keepdims=True)
    usual = parent_counts[parents] / np.maximum(parent_counts[parents].sum(axis=1, keepdims=True), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(counts > 0, counts * np.log(counts / n / usual), 0.0)
    diverges = terms.sum(axis=1, keepdims=True) > 0.5 * different * np.log(np.maximum(n, 2))
    own = (counts + different * parent_p[parents]) / np.maximum(n + different, 1)
    return np.where(diverges, own, parent_p[parents])


def check_base(rows, got):
    train = Counter()
    texts = {i: [*(text or "").encode().lower().split(), None] for i, text in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, tokens in texts.items():
        if not held[i]:
            train.update(tokens)
    total, distinct = sum(train.values()), len(train)
    assert len(got) == len(rows)
    for r in got:
        tokens = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), total)
        assert r.n_known == sum(train[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(sum(log10((train[t] + 1) / (total + distinct + 1)) for t in tokens))
        assert np.isfinite(r.score) and r.score <= 0


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score_texts(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    # Better than single words on texts it has not seen.
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_context_decides(docs_of, rng):
    """Words that alternate are likelier than the same words in random order."""
    texts = ["red one blue two " * 50 for _ in range(60)]
    words = texts[0].split()
    shuffled = [" ".join(rng.sample(words, len(words))) for _ in range(20)]
    got = score_texts(docs_of([*texts, *shuffled])).collect()
    regular = [r.score for r in got if r.doc_id < 60 and r.held_out]
    random = [r.score for r in got if r.doc_id >= 60 and r.held_out]
    assert regular and random and min(regular) > 2 * max(random)
    assert all(r.score > r.base_score for r in got if r.doc_id < 60)


def test_edges(docs_of):
    texts = [None, "", " \n", "a", "A b\tb", "é É", "z " * 30_000] * 6
    docs = docs_of(texts, train=["x"] * len(texts), block=["y"] * len(texts))
    check_base([(i, t) for i, t in enumerate(texts)], score_texts(docs).collect())


def test_missing_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert score_texts(spark.createDataFrame([], schema)).count() == 0
    got = score_texts(spark.createDataFrame([(None, "a b"), (None, "a b")], schema)).collect()
    assert [(r.doc_id, r.n_known, r.train_tokens) for r in got] == [(None, 3, 6)] * 2
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (alone,) = score_texts(spark.createDataFrame([(held, "a b")], schema)).collect()
    assert (alone.base_score, alone.score, alone.n_known) == (0, 0, 0)


def test_states_are_distributions():
    draw = np.random.default_rng(3)
    root = draw.integers(1, 50, (1, 40)).astype(float)
    counts = draw.integers(0, 9, (5, 40)).astype(float)
    counts[0, 3] = 500  # far from its parent
    counts[2] = root[0]  # as its parent: no state of its own
    p = root / root.sum()
    got = smoothed(counts, np.zeros(5, int), root, p)
    assert got.sum(axis=1) == pytest.approx(np.ones(5))
    different = (counts[0] > 0).sum()
    assert np.allclose(got[0], (counts[0] + different * p[0]) / (counts[0].sum() + different))
    assert np.allclose(got[2], p[0])


def test_next_level_extends_known_contexts():
    counts = np.zeros((2, CLASSES + 2))
    counts[0, 1] = counts[1, 0] = counts[0, END] = 5
    longer, parents = next_level(counts, [(0,), (1,)], 5)
    assert longer == [(0, 1), (1, 0)] and parents == [1, 0]


def dense_scores(texts, depth=3):
    """The whole tree as dense tables over all words: every context found twice may be a state."""
    tokens = {i: [*text.encode().lower().split(), None] for i, text in enumerate(texts)}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    words = sorted({w for t in train for w in t[:-1]})
    index = {None: END} | {w: k if k < END else k + 1 for k, w in enumerate(words)}
    size = max(len(words) + 1, END + 1)
    n_docs, total = len(train), sum(map(len, train))
    root = np.zeros((1, size))
    for t in train:
        np.add.at(root[0], [index[w] for w in t], 1)
    p = np.where(root > 0, root + 1, 0) / (root.sum() + (root > 0).sum())
    once = (root == 1).sum() / total
    counts, states, levels = root, [()], [({(): 0}, p)]

    def context(t, at, length):
        return tuple(index[t[at - k]] if at >= k else END for k in range(length, 0, -1))

    for length in range(1, depth + 1):
        longer, _ = next_level(counts, states, 2)
        longer = [*longer, (END,) * length] if length > 1 else [(s,) for s in range(size) if root[0, s] >= 2]
        if length > 1 and n_docs > 1:  # those at a text's start
            found = Counter(context(t, at, length) for t in train for at in range(1, min(length, len(t))))
            longer += [c for c, n in found.items() if n >= 2 and c[0] == END and c not in longer]
        of = {c: k for k, c in enumerate(longer)}
        new = np.zeros((len(longer), size))
        for t in train:
            for at, w in enumerate(t):
                if (k := of.get(context(t, at, length))) is not None:
                    new[k, index[w]] += 1
        p = smoothed(new, np.array([states.index(c[1:]) for c in longer]), counts, p)
        levels.append((of, p))
        counts, states = new, longer
    scores = {}
    for i, t in tokens.items():
        score = 0.0
        for at, w in enumerate(t):
            if w not in index:
                score += log10(once)
                continue
            # A context may hold words that training lacks.
            own = tuple(index.get(t[at - k], -1) if at >= k else END for k in range(depth, 0, -1))
            length = max(n for n in range(depth + 1) if own[depth - n :] in levels[n][0])
            of, q = levels[length]
            score += log10(q[of[own[depth - length :]], index[w]] * (1 - once))
        scores[i] = score
    return scores


def test_equals_the_dense_tree(docs_of, rng, monkeypatch):
    """Rare words and contexts count as they are, however small their share."""
    monkeypatch.setattr(module, "BLOCK_TOKENS", 300)
    words = [f"w{k}" for k in range(400)]
    phrases = [rng.sample(words, 6) for _ in range(40)]
    texts = [
        " ".join(w for _ in range(rng.randrange(1, 12)) for w in (rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(words)]))
        for _ in range(150)
    ]
    want = dense_scores(texts)
    for r in score_texts(docs_of(texts)).collect():
        assert r.score == pytest.approx(want[r.doc_id])
