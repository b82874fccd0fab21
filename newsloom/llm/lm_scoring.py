"""Scoring texts with a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import whole
from newsloom.llm.hashing import WordHashes, texts
from newsloom.session import written

FOLDS, HELD_OUT = 7, 2
DEPTH = 3  # the longest context
LEAST = 2  # a context that training has so often may be a state
BLOCK_TOKENS = 500_000
SHARD_WORDS = 1_000_000
SHARD_PAIRS = 3_000_000
NO_ID = -(2**63)  # stands for a NULL id

BLOCK = (
    "block long, n_train long, n_train_docs long, n_tokens long, n_words long, docs binary, train binary, "
    "lengths binary, tokens binary, hashes binary, counts binary"
)
ASK = "shard int, block long, hashes binary, counts binary"
PAIR_ASK = "shard int, block long, numbers binary"
ANSWER = "shard int, block long, answer binary, n_new long, n_once long, heavy binary"
HEAVY = "context long, n long, different long, parent_n long, terms double"
SCORE = "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sent(*arrays: np.ndarray) -> bytes:
    """Integers from 0 as their byte planes, without those that are empty, compressed."""
    head, planes = [], []
    for values in arrays:
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        head += [len(values), width]
        planes.append(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(np.array(head, "<i8").tobytes() + b"".join(planes), 1)


def _received(data: bytes, n: int) -> Iterator[np.ndarray]:
    """The ``n`` arrays of integers that were sent."""
    raw, at = np.frombuffer(zstandard.decompress(data), np.uint8), 16 * n
    for length, width in raw[:at].view("<i8").reshape(n, 2).tolist():
        values = np.zeros((length, 8), np.uint8)
        values[:, :width] = raw[at : at + length * width].reshape(width, length).T
        at += length * width
        yield values.reshape(-1).view("<i8")


def _coded(totals: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Training counts such that from 2 on they are of what two places at least hold, training or held out."""
    return totals + ((totals >= 2) | ((totals == 1) & held))


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes - (codes >= 2)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers into the words of their block, which are in the order of their hashes."""
    part = TaskContext.get().partitionId()
    hashes = WordHashes()
    nth, numbers, docs, trains, rows = 0, _Numbers(), [], [], []

    def block() -> pa.RecordBatch:
        lengths = np.array([len(r) for r in rows], np.int64)
        of = hashes.of(list(numbers))
        order = np.argsort(of)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        tokens = number[np.concatenate(rows)]
        train = np.array(trains, bool)
        of_train = np.repeat(train, lengths)
        counts = np.bincount(tokens[of_train], minlength=len(of))
        held = np.bincount(tokens[~of_train], minlength=len(of)) > 0
        values = (
            (part << 32) + nth,
            int(lengths[train].sum() + train.sum()),
            int(train.sum()),
            int(lengths.sum() + len(lengths)),
            len(of),
            np.array(docs, np.int64).tobytes(),
            train.tobytes(),
            _sent(lengths),
            _sent(tokens),
            of[order].tobytes(),
            _sent(2 * counts + held),
        )
        kinds = [pa.int64()] * 5 + [pa.binary()] * 6
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

    size = 0
    for group in texts(batches):
        for doc, train, text in group:
            words = text.lower().split()
            rows.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            docs.append(doc)
            trains.append(train)
            size += len(words) + 1
            if size >= BLOCK_TOKENS:
                yield block()
                nth, numbers, docs, trains, rows, size = nth + 1, _Numbers(), [], [], [], 0
    if rows:
        yield block()


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Shards that are ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.record_batch(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
    )


def _asks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's words, by shards of their hashes."""
    for batch in batches:
        for block, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = np.frombuffer(hashes, np.uint64)
            (counts,) = _received(counts, 1)
            shard = _ranges(hashes, shards)
            present, first = np.unique(shard, return_index=True)
            rows = [
                (s, block, hashes[i:j].tobytes(), _sent(counts[i:j]))
                for s, i, j in zip(present.tolist(), first, [*first[1:], len(shard)])
            ]
            yield _table(rows, ASK)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Of a partition sorted by shard: each shard with its rows."""
    last, parts = None, []
    for batch in batches:
        for shard, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != last and parts:
                yield last, parts
                parts = []
            last = shard
            parts.append(tuple(part))
    if parts:
        yield last, parts


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words with their counts in all blocks, and the numbers within the shard of those that training
    has. The first row of a shard also has its sums: words that training has, words that it has once."""
    for shard, parts in _by_shard(batches):
        hashes = np.concatenate([np.frombuffer(h, np.uint64) for _, h, _ in parts])
        counts = np.concatenate([next(_received(c, 1)) for _, _, c in parts])
        distinct, of = np.unique(hashes, return_inverse=True)
        totals = np.bincount(of, weights=counts >> 1, minlength=len(distinct)).astype(np.int64)
        codes = _coded(totals, np.bincount(of, weights=counts & 1, minlength=len(distinct)) > 0)
        number = np.cumsum(totals > 0) - 1
        sums = (int((totals > 0).sum()), int((totals == 1).sum()))
        rows, at = [], 0
        for block, h, _ in parts:
            mine = of[at : at + len(h) // 8]
            own = codes[mine]
            answer = _sent(own, np.diff(number[mine[own > 0]], prepend=0))
            rows.append((shard, block, answer, *(sums if not at else (0, 0)), None))
            at += len(mine)
        yield _table(rows, ANSWER)


class Corpus(NamedTuple):
    """Sums over the training texts, and how many shards hold pairs."""

    n_tokens: int  # ends included
    n_distinct: int
    n_once: int
    n_docs: int
    pair_shards: int


def _sequences(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: the numbers of its words with an end (the number after the words') after each text, and the
    texts' first places."""
    (lengths,) = _received(row["lengths"], 1)
    (tokens,) = _received(row["tokens"], 1)
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = np.full(len(tokens) + len(lengths), row["n_words"], np.int64)
    is_word = np.ones(len(words), bool)
    is_word[starts + lengths] = False
    words[is_word] = tokens
    return words, starts


class Level(NamedTuple):
    """What is known of a level when it has been answered."""

    first: np.ndarray  # of each shard: the number of its first word or pair that may be a context
    n_new: int  # how many there are
    known: np.ndarray  # the heavy contexts, sorted
    weights: np.ndarray  # of these


class Asked(NamedTuple):
    """What a block asks on one level. Places with one context are a run, places with one pair of a context and the next
    word a pair; both are in the order of shards, contexts and next words."""

    places: np.ndarray  # those whose context training has LEAST times, in that order
    run_of: np.ndarray
    pair_of: np.ndarray
    is_pair: np.ndarray  # else the count of the pair is that after the shorter context
    runs: np.ndarray  # where each run begins among the places
    pairs: np.ndarray  # where each pair begins
    shards: np.ndarray  # of the runs; those of heavy contexts come after all others


def _asked(
    contexts: np.ndarray, words: np.ndarray, ids: np.ndarray, known: np.ndarray, usual: np.ndarray, n: np.ndarray,
    n_contexts: int, corpus: Corpus,
) -> Asked:
    """Contexts are dealt by ranges of their numbers. A context is heavy when it holds a shard's part of the training
    tokens, so there are no more of them than shards; its pairs are dealt by the next word.

    A pair is not asked for if training has it nowhere after the shorter context, or in one place only and held-out
    texts have it nowhere: its count is the same."""
    shards = corpus.pair_shards
    active = np.flatnonzero((n >= LEAST) & known)
    run, word, asks = contexts[active], words[active], usual[active] >= 2
    shard = run * shards // n_contexts
    heavy = n[active] * shards >= corpus.n_tokens
    if heavy.any():
        of = np.unique(run[heavy], return_inverse=True)[1]
        spread = ids[word[heavy]] * shards // corpus.n_distinct
        shard[heavy] = shards + spread
        run[heavy] = n_contexts + spread * (int(of.max()) + 1) + of
    slots = len(ids) + 1
    key = run * slots + np.where(asks, word + 1, 0)
    order = np.argsort(key)
    key, run, is_pair = key[order], run[order], asks[order]
    new_run, new_pair = np.ones(len(key), bool), is_pair.copy()
    new_run[1:] = run[1:] != run[:-1]
    new_pair[1:] &= key[1:] != key[:-1]
    runs = np.flatnonzero(new_run)
    return Asked(
        active[order], np.cumsum(new_run) - 1, np.cumsum(new_pair) - 1, is_pair, runs, np.flatnonzero(new_pair),
        shard[order][runs],
    )


class Places(NamedTuple):
    """Of each token: its training count, and its probability in the longest state so far; then what
    the next level asks for, and what the shards need for it."""

    count: np.ndarray
    p: np.ndarray
    starts: np.ndarray
    asked: Asked | None
    numbers: tuple  # contexts, words, ids, training places, coded counts after and counts of the shorter context


def _places(row: dict, corpus: Corpus, levels: list[Level], ask: bool) -> Places:
    """A block's tokens with the answers of ``levels``."""
    words, starts = _sequences(row)
    train = np.repeat(np.frombuffer(row["train"], bool), np.diff(np.r_[starts, len(words)]))
    codes, ids, at = np.zeros(row["n_words"] + 1, np.int64), np.full(row["n_words"] + 1, -1), 0
    for answer in sorted(row["answers0"], key=lambda answer: answer["shard"]):
        own, numbers = _received(answer["answer"], 2)
        codes[at : at + len(own)] = own
        ids[at + np.flatnonzero(own)] = levels[0].first[answer["shard"]] + np.cumsum(numbers)
        at += len(own)
    codes[-1], ids[-1] = corpus.n_docs + (corpus.n_docs > 0), levels[0].n_new
    code = codes[words]
    count = total = _decoded(code)
    known = count > 0
    n = np.full(len(words), corpus.n_tokens, np.int64)
    p = (count + 1) / max(corpus.n_tokens + corpus.n_distinct, 1)
    ending = ids[words]  # the number of what ends at a place: a word, then one of the contexts of a level
    for level in range(1, len(levels) + ask):
        # A context is what ends before a place; before a text are ends only.
        before = levels[level - 1].n_new
        contexts, longer = np.r_[-1, ending[:-1]], np.r_[0, total[:-1]]
        contexts[starts], longer[starts] = before, corpus.n_docs
        asked = _asked(contexts, words, ids, known, code, longer, before + 1, corpus)
        if level == len(levels):
            return Places(count, p, starts, asked, (contexts, words, ids, train, code, n))
        usual, n, code, ending = code, longer, np.zeros(len(words), np.int64), np.full(len(words), -1)
        if not len(asked.places):
            total = code
            continue
        found, weights, numbers = [], [], []
        for answer in sorted(row[f"answers{level}"], key=lambda answer: answer["shard"]):
            own, new, of_runs = _received(answer["answer"], 3)
            found.append(own)
            weights.append(of_runs)
            numbers.append(levels[level].first[answer["shard"]] + np.cumsum(new))
        found, numbers = np.concatenate(found), np.concatenate(numbers)
        heavy = asked.runs[asked.shards >= corpus.pair_shards]
        heavy = levels[level].weights[np.searchsorted(levels[level].known, contexts[asked.places[heavy]])]
        w = np.concatenate([*weights, heavy])[asked.run_of]
        code[asked.places] = usual[asked.places]
        of_pairs, pair_of = asked.places[asked.is_pair], asked.pair_of[asked.is_pair]
        code[of_pairs] = found[pair_of]
        total = _decoded(code)
        if len(numbers):
            pair_ids = np.full(len(found), -1)
            pair_ids[_decoded(found) >= LEAST] = numbers
            ending[of_pairs] = pair_ids[pair_of]
        shorter = p[asked.places]
        p[asked.places] = np.where(w > 0, (total[asked.places] + w * shorter) / (n[asked.places] + w), shorter)
    return Places(count, p, starts, None, ())


def _pair_asks(batches: Iterator[pa.RecordBatch], corpus: Corpus, levels: list[Level]) -> Iterator[pa.RecordBatch]:
    """By shards: a block's contexts of the next level, each with the number of its pairs, how many training places
    have a pair found once, and the count of the shorter context; then the pairs, each with the next word, its count in
    the block's training texts and whether held-out texts have it, and its count after the shorter context."""
    for batch in batches:
        for row in batch.to_pylist():
            places = _places(row, corpus, levels, True)
            asked, (contexts, words, ids, train, usual, parent_n) = places.asked, places.numbers
            n_runs, n_pairs = len(asked.runs), len(asked.pairs)
            at, of = asked.places[asked.runs], asked.places[asked.pairs]
            sizes = np.bincount(asked.run_of[asked.pairs], minlength=n_runs)
            single = ~asked.is_pair & (usual[asked.places] == 1)
            ones = np.bincount(asked.run_of[single], minlength=n_runs)
            of_train = train[asked.places]
            counts = np.bincount(asked.pair_of[asked.is_pair & of_train], minlength=n_pairs)
            held = np.bincount(asked.pair_of[asked.is_pair & ~of_train], minlength=n_pairs) > 0
            following = ids[words[of]]
            steps = np.diff(following, prepend=0)
            ends = np.cumsum(sizes)
            begins = (ends - sizes)[sizes > 0]
            steps[begins] = following[begins]
            present, first = np.unique(asked.shards, return_index=True)
            rows = []
            for s, i, j in zip(present.tolist(), first, [*first[1:], n_runs]):
                mine = slice(ends[i] - sizes[i], ends[j - 1])
                numbers = (
                    np.diff(contexts[at[i:j]], prepend=0), sizes[i:j], ones[i:j], parent_n[at[i:j]],
                    steps[mine], 2 * counts[mine] + held[mine], _decoded(usual[of[mine]]),
                )
                rows.append((s, row["block"], _sent(*numbers)))
            yield _table(rows, PAIR_ASK)


def state_weights(different: np.ndarray, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the shorter context's distribution weighs in a state; 0 for contexts that are no states. ``terms`` is n times the
    Kullback-Leibler divergence of the next words from those of the shorter context."""
    return np.where(terms > 0.5 * different * np.log(np.maximum(n, 2)), different, 0)


def _pair_answers(batches: Iterator[pa.RecordBatch], corpus: Corpus, last: bool) -> Iterator[pa.RecordBatch]:
    """Each block's pairs with their counts in all blocks, the numbers within the shard of those that may be
    contexts (none on the last level), and its contexts' weights. Of heavy contexts the first row of a shard has
    its part of the sums instead."""
    for shard, parts in _by_shard(batches):
        received = [list(_received(numbers, 7)) for _, numbers in parts]
        for numbers in received:
            numbers[0] = np.cumsum(numbers[0])
            steps, sizes = numbers[4], numbers[1]
            begins = np.cumsum(sizes) - sizes
            following = np.cumsum(steps)
            base = np.r_[0, following][begins[sizes > 0]]
            numbers[4] = following - np.repeat(base, sizes[sizes > 0])
        run_ends = np.cumsum([len(numbers[0]) for numbers in received])
        ends = np.cumsum([len(numbers[4]) for numbers in received])
        contexts, sizes, ones, parents, following, counts, usual = map(np.concatenate, zip(*received))
        del received
        distinct, of_run = np.unique(contexts, return_inverse=True)
        parent_n = np.empty(len(distinct), np.int64)
        parent_n[of_run] = parents
        ones = np.bincount(of_run, weights=ones, minlength=len(distinct)).astype(np.int64)
        key = np.repeat(of_run, sizes) * corpus.n_distinct + following
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        totals = np.bincount(group, weights=counts >> 1, minlength=len(first)).astype(np.int64)
        codes = _coded(totals, np.bincount(group, weights=counts & 1, minlength=len(first)) > 0)
        seen = np.flatnonzero(totals)
        context, t = key[first[seen]] // corpus.n_distinct, totals[seen]
        shorter = usual[order[first[seen]]]
        n = np.bincount(context, weights=t, minlength=len(distinct)).astype(np.int64) + ones
        different = np.bincount(context, minlength=len(distinct)) + ones
        weights, sums = np.zeros(0, np.int64), None
        if shard < corpus.pair_shards:
            # Logarithms of ratios, so that a divergence just at the limit is not lifted above it by rounding.
            terms = t * np.log(t / n[context] / (shorter / parent_n[context]))
            terms = np.bincount(context, weights=terms, minlength=len(distinct)) + ones * np.log(1 / n / (1 / parent_n))
            weights = state_weights(different, terms, n)[of_run]
        else:
            terms = np.bincount(context, weights=t * (np.log(t) - np.log(shorter)), minlength=len(distinct))
            sums = b"".join(a.astype("<i8").tobytes() for a in (distinct, n, different, parent_n)) + terms.tobytes()
        again = np.zeros(len(totals), bool) if last else totals >= LEAST
        number = np.cumsum(again) - 1
        rows = []
        for k, (block, _) in enumerate(parts):
            mine = group[ends[k - 1] if k else 0 : ends[k]]
            numbers = np.diff(number[mine[again[mine]]], prepend=0)
            own = weights[run_ends[k - 1] if k else 0 : run_ends[k]]
            firsts = (int(again.sum()), 0, sums) if not k else (0, 0, None)
            rows.append((shard, block, _sent(codes[mine], numbers, own), *firsts))
        yield _table(rows, ANSWER)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sums in batch.column(0).to_pylist():
            *whole_numbers, terms = np.frombuffer(sums, "<i8").reshape(5, -1)
            columns = [*map(pa.array, whole_numbers), pa.array(terms.view(np.float64))]
            yield pa.record_batch(columns, names=[field.split()[0] for field in HEAVY.split(", ")])


def _level(answers: DataFrame, shards: int) -> Level:
    """Numbers of shards and of heavy contexts, of which there are no more than shards."""
    new = np.zeros(shards + 1, np.int64)
    for shard, n_new in answers.filter("n_new > 0").groupBy("shard").agg(F.sum("n_new")).collect():
        new[shard + 1] = n_new
    first = np.cumsum(new)
    sums = [F.sum(c).alias(c) for c in ("n", "different", "terms")]
    rows = (
        answers.filter("heavy is not null").select("heavy").mapInArrow(_heavy, HEAVY)
        .groupBy("context").agg(*sums, F.max("parent_n").alias("parent_n"))
        .orderBy("context").toArrow()
    )
    context, n, different, terms, parent_n = (column.to_numpy() for column in rows.columns)
    divergence = terms + n * (np.log(parent_n) - np.log(n))
    return Level(first[:-1], int(first[-1]), context, state_weights(different, divergence, n).astype(np.int64))


def _scores(batches: Iterator[pa.RecordBatch], corpus: Corpus, levels: list[Level]) -> Iterator[pa.RecordBatch]:
    base_total = corpus.n_tokens + corpus.n_distinct + 1
    for batch in batches:
        for row in batch.to_pylist():
            places = _places(row, corpus, levels, False)
            c, starts = places.count, places.starts
            base = np.log10((c + 1) / base_total)
            if corpus.n_tokens:
                unseen = corpus.n_once / corpus.n_tokens if corpus.n_once else 1 / base_total
                with np.errstate(divide="ignore"):
                    log = np.log10(places.p) + np.log10(1 - unseen)
                log[c == 0] = np.log10(unseen)
            else:
                log = base
            lengths = np.diff(np.r_[starts, len(c)])
            yield pa.record_batch(
                [
                    pa.array(np.frombuffer(row["docs"], np.int64)),
                    pa.array(~np.frombuffer(row["train"], bool)),
                    pa.array(lengths),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(starts), corpus.n_tokens, np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(log, starts)),
                ],
                names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def _known(sent: tuple) -> tuple[Corpus, list[Level]]:
    corpus, levels = sent
    return Corpus(*corpus), [Level(*level) for level in levels]


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Each block with the answers of every level so far, one row per shard and block."""
    for level, own in enumerate(answers):
        name = f"answers{level}"
        got = own.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias(name))
        none = F.array().cast("array<struct<shard:int,answer:binary>>")
        blocks = blocks.join(got, "block", "left").withColumn(name, F.coalesce(name, none))
    return blocks


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z in lower case, and an end. Documents whose crc32(id) modulo 7 is 2 are
    held out, the others train. ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens.

    ``score`` comes from a probabilistic suffix tree. Its symbols are all words of the training texts and the end.
    Every context of up to ``depth`` words that training has ``LEAST`` times is a state if its next words
    diverge from those of the context one shorter: if its count times the Kullback-Leibler divergence exceeds half its
    number of different next words times the logarithm of its count. A state's counts are smoothed with the distribution
    of the shorter context, which weighs as much as there are different next words. A token is scored in the state of the
    longest context that precedes it. A word that training lacks has the share of words that training has once.

    Neither words nor contexts are bounded, and neither ever meet: documents become blocks of numbered words;
    each block sends its distinct words to the shards of their hashes, and gets their
    counts and numbers in the corpus back. Then, level by level, it sends its distinct pairs of a context and the next
    word, and gets back their counts and numbers, and whether the context is a state. A pair found ``LEAST`` times is a
    context of the next level, and its number stands for it; so contexts are told apart exactly, and sorted numbers are
    short. Contexts below ``LEAST`` are never sent, nor pairs whose count follows from the shorter context. The
    pairs of heavy contexts go to many shards. Only words are told apart by 64-bit hashes.

    NULL or empty text is the end alone. Rows without id train; repeated rows each count. An
    empty table gives an empty result; without training documents both scores are 0. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"),
        (F.crc32(name) % FOLDS != HELD_OUT).alias("train"),
        whole().cast("binary").alias("text"),
    )
    blocks = written(source.mapInArrow(_blocks, BLOCK), "blocks")
    n_train, n_docs, n_tokens, n_words = (
        x or 0 for x in blocks.agg(*[F.sum(c) for c in ("n_train", "n_train_docs", "n_tokens", "n_words")]).first()
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards, pair_shards = max(-(-n_words // SHARD_WORDS), least), max(-(-n_tokens // SHARD_PAIRS), least)
    answers = [
        written(
            blocks.select("block", "hashes", "counts")
            .mapInArrow(lambda x: _asks(x, word_shards), ASK)
            .repartition(word_shards, "shard")
            .sortWithinPartitions("shard")
            .mapInArrow(_answers, ANSWER),
            "answers",
        )
    ]
    levels = [_level(answers[0], word_shards)]
    n_once = answers[0].agg(F.sum("n_once")).first()[0] or 0
    corpus = Corpus(n_train, levels[0].n_new + (n_docs > 0), n_once + (n_docs == 1), n_docs, pair_shards)
    blocks = blocks.select("block", "n_words", "docs", "train", "lengths", "tokens")
    for level in range(1, depth + 1):
        # Plain tuples: a broadcast does not carry the package's classes.
        sent = spark.sparkContext.broadcast((tuple(corpus), [tuple(x) for x in levels]))
        own = written(
            _with_answers(blocks, answers)
            .mapInArrow(lambda x, sent=sent: _pair_asks(x, *_known(sent.value)), PAIR_ASK)
            .repartition(pair_shards, "shard")
            .sortWithinPartitions("shard")
            .mapInArrow(lambda x, sent=sent, last=level == depth: _pair_answers(x, _known(sent.value)[0], last), ANSWER),
            "answers",
        )
        levels.append(_level(own, 2 * pair_shards))
        answers.append(own)
    sent = spark.sparkContext.broadcast((tuple(corpus), [tuple(x) for x in levels]))
    scored = _with_answers(blocks, answers).mapInArrow(lambda x: _scores(x, *_known(sent.value)), SCORE)
    return scored.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), *scored.columns[1:])
