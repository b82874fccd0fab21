"""Near-duplicates by SetSketch registers, banded, estimated by likelihood, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import whole
from newsloom.llm.components import connected_components
from newsloom.llm.hashing import WordHashes, by_ids, shingle_set, texts
from newsloom.llm.setsketch import REGISTERS, jaccard, registers
from newsloom.session import written

WIDTH = 5
PERCENT = 75
BAND = 4  # registers in a band
DEVIATIONS = 5  # of the estimate, below the threshold, at which a pair is still verified
BLOCK = 128  # documents in a block
CELL = 1000  # documents of small groups compared in one task
NO_ID = -(2**63)  # stands for a NULL id

SKETCH = "doc long, n_shingles long, set_hash binary, registers binary"


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for rows in texts(batches):
        sets = [shingle_set(text, hashes, width) for _, text in rows]
        filled = [i for i, s in enumerate(sets) if len(s)]
        found = [None] * len(rows)
        if filled:
            owner = np.repeat(np.arange(len(filled)), [len(sets[i]) for i in filled])
            values = registers(np.concatenate([sets[i] for i in filled]), owner, len(filled))
            for i, value in zip(filled, values):
                found[i] = value.tobytes()
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.record_batch(
            [
                pa.array([doc for doc, _ in rows], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(found, pa.binary()),
            ],
            names=["doc", "n_shingles", "set_hash", "registers"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = REGISTERS // BAND
    for batch in batches:
        docs = batch.column(0).to_numpy()
        parts = [r.as_py() for r in batch.column(1)]
        step = 2 * BAND
        keys = [
            xxhash.xxh3_64_intdigest(part[i * step : (i + 1) * step], seed=i) for part in parts for i in range(n_bands)
        ]
        yield pa.record_batch(
            [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(docs, n_bands))],
            names=["band", "doc"],
        )


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3)
        )
        sizes = [batch.column(k).to_numpy().astype(float) for k in (4, 5)]
        keep = np.concatenate(
            [
                jaccard(left[i : i + 4096], right[i : i + 4096], *(s[i : i + 4096] for s in sizes))
                for i in range(0, len(left), 4096)
            ]
        )
        yield batch.select([0, 1]).filter(pa.array(keep >= least))


def _verified(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last, left = None, None
    for batch in batches:
        keep = []
        for a, _, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)):
            if left is None or last != (a, text_a):
                last, left = (a, text_a), shingle_set(text_a, hashes, width)
            right = shingle_set(text_b, hashes, width)
            both = len(np.intersect1d(left, right, assume_unique=True))
            union = len(left) + len(right) - both
            keep.append(both > 0 and 100 * both >= percent * union)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class _Links:
    """Links between sketched classes, from candidate pairs."""

    def __init__(self, source: DataFrame, classes: DataFrame, width: int, percent: int):
        self.source, self.classes, self.width, self.percent = source, classes, width, percent

    def of(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar on their full sets."""
        least = self.percent / 100
        margin = DEVIATIONS * sqrt(least * (1 - least) / REGISTERS)
        a, b = (
            self.classes.select(F.col("doc").alias(k), F.col("registers").alias(f"r{k}"), F.col("n_shingles").alias(f"n{k}"))
            for k in "ab"
        )
        sketched = (
            pairs.join(a, "a")
            .join(b, "b")
            .filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
            .select("a", "b", "ra", "rb", "na", "nb")
        )
        likely = written(sketched.mapInArrow(lambda x: _likely(x, least - margin), "a long, b long"), "likely")
        asked = likely.select(F.col("a").alias("doc")).unionAll(likely.select(F.col("b").alias("doc"))).distinct()
        found = written(by_ids(self.source, asked, "doc"), "texts")
        left, right = (found.select(F.col("doc").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        width, percent = self.width, self.percent
        return written(
            likely.join(left, "a")
            .join(right, "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda x: _verified(x, width, percent), "a long, b long"),
            "links",
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for rows in texts(batches):
        sets = [shingle_set(text, hashes, width).tobytes() for _, text in rows]
        yield pa.record_batch(
            [pa.array([doc for doc, _ in rows], pa.int64()), pa.array(sets, pa.binary())], names=["doc", "shingles"]
        )


def _compare(left: pa.Table, right: pa.Table, percent: int, least: float) -> list[tuple[int, int]]:
    """Links between the documents of two blocks that belong to different parts."""
    x, y = left.to_pydict(), right.to_pydict()
    parts = [np.array(t["part"], np.int64) for t in (x, y)]
    sketches = [np.frombuffer(b"".join(t["registers"]), np.uint16).reshape(-1, REGISTERS) for t in (x, y)]
    sets = [[np.frombuffer(s, np.uint64) for s in t["shingles"]] for t in (x, y)]
    sizes = [np.array([len(s) for s in own], np.int64) for own in sets]
    # Registers agree at least as often as the sets are similar: few agreements need no likelihood.
    alike = np.array([(sketches[1] == one).sum(axis=1) for one in sketches[0]]) >= least * REGISTERS
    i, j = np.nonzero(alike & (parts[0][:, None] != parts[1][None, :]))
    fits = 100 * np.minimum(sizes[0][i], sizes[1][j]) >= percent * np.maximum(sizes[0][i], sizes[1][j])
    i, j = i[fits], j[fits]
    likely = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        k, m = i[at : at + 4096], j[at : at + 4096]
        likely[at : at + 4096] = jaccard(sketches[0][k], sketches[1][m], sizes[0][k], sizes[1][m]) >= least
    i, j = i[likely], j[likely]
    if not len(i):
        return []
    # Exact sizes of the intersections, from one sorted list of the right block's shingles.
    elements, owner = np.concatenate(sets[1]), np.repeat(np.arange(len(sets[1])), sizes[1])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    both = np.zeros((len(sets[0]), len(sets[1])), np.int64)
    for k in np.unique(i):
        low, high = np.searchsorted(elements, sets[0][k], "left"), np.searchsorted(elements, sets[0][k], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both[k] = np.bincount(owner[at], minlength=len(sets[1]))
    shared = both[i, j]
    linked = (shared > 0) & (100 * shared >= percent * (sizes[0][i] + sizes[1][j] - shared))
    return [(x["doc"][k], y["doc"][m]) for k, m in zip(i[linked], j[linked])]


def _crossing(source: DataFrame, classes: DataFrame, open_docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different parts under one ``main``: of the documents outside the main part with all
    documents there, in blocks. Only links leave a block, and a document is sent once for every block it meets."""
    least = percent / 100 - DEVIATIONS * sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    asked = open_docs.select("doc").distinct()
    sets = written(by_ids(source, asked, "doc").mapInArrow(lambda x: _sets(x, width), "doc long, shingles binary"), "sets")
    counts = open_docs.groupBy("main").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"),
        F.ceil(F.count_if(F.col("part") != F.col("main")) / BLOCK).alias("n_stray_blocks"),
    )
    n_cells = max(1, open_docs.count() // CELL)
    rows = written(
        open_docs.join(counts, "main").join(classes.select("doc", "registers"), "doc").join(sets, "doc"), "rows"
    )
    mine, other = F.pmod(F.xxhash64("doc"), F.col("n_blocks")), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("n_stray_blocks"))
    # Small groups share cells; pairs of blocks of a large one have cells of their own.
    cell = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("main"), F.lit(n_cells))).otherwise(F.xxhash64("main", "i", "j"))
    columns = ["cell", "main", "doc", "part", "registers", "shingles"]
    strays = (
        rows.filter("part <> main")
        .withColumns({"i": other, "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))})
        .select(cell.alias("cell"), *columns[1:])
    )
    everyone = rows.withColumns(
        {"j": mine, "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_stray_blocks") - 1))}
    ).select(cell.alias("cell"), *columns[1:])

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        links = []
        if left.num_rows and right.num_rows:
            mains = [t.column("main").to_numpy() for t in (left, right)]
            for main in np.unique(mains[0]):
                own = [t.filter(pa.array(m == main)) for t, m in zip((left, right), mains)]
                if own[1].num_rows:
                    links += _compare(*own, percent, least)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = strays.groupBy("cell").cogroup(everyone.groupBy("cell")).applyInArrow(compared, "a long, b long")
    return written(found.distinct(), "crossing")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``width`` words, A-Z in lower case; a
    shorter text is one shingle, an empty one has an empty set and is linked
    with nothing. Documents are linked when 100 * intersection >= percent * union.
    A component is named by its smallest id, which is the one kept.

    Documents with one set are one class from the start. Each class has 128
    SetSketch registers in 32 bands of 4; at similarity 0.75 two classes miss each other in all bands with
    probability 5e-6. In a bucket, all classes are first compared with its smallest one. After
    the links found so far are joined to components, the classes outside a bucket's largest component are
    compared with all others there, in blocks of 128 that only links leave. So a bucket of near copies of
    one text costs one comparison for each, and no pair that shares a bucket is left
    open: it is in one component, or was compared. Pairs go on when the likelihood
    estimate lies above the threshold less five deviations, and are verified on
    their full sets.

    NULL text is empty. Rows with one id are one document: if their texts differ,
    both sets link it. Rows without id are taken as one document too. An empty
    table gives an empty result. Other columns are ignored.
    """
    source = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), whole().cast("binary").alias("text")
    )
    sketched = written(source.mapInArrow(lambda x: _sketch(x, width), SKETCH), "sketches")
    classes = written(
        sketched.filter("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min("doc").alias("doc"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("registers").alias("registers")),
        "classes",
    )
    banded = written(classes.select("doc", "registers").mapInArrow(_bands, "band long, doc long"), "bands")
    firsts = banded.groupBy("band").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(banded.join(firsts.select("band", "a"), "band"), "shared")
    links = _Links(source, classes, width, percent)
    stars = links.of(shared.select("a", F.col("doc").alias("b")).filter("a <> b").distinct())

    # What is left: buckets with several components.
    parts = written(connected_components(stars.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "parts")
    placed = shared.select("band", "doc").join(parts.withColumnRenamed("node", "doc"), "doc", "left").select(
        "band", "doc", F.coalesce("component", "doc").alias("part")
    )
    sizes = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    main = (
        sizes.groupBy("band")
        .agg(F.max_by("part", F.struct("n", F.bitwise_not("part"))).alias("main"), F.count(F.lit(1)).alias("n_parts"))
        .filter("n_parts > 1")
        .drop("n_parts")
    )
    open_docs = written(placed.join(main, "band").select("main", "doc", "part").distinct(), "open")
    found = stars.unionByName(_crossing(source, classes, open_docs, width, percent))

    whole_graph = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = classes.select("set_hash", "doc").join(
        whole_graph.withColumnRenamed("node", "doc"), "doc", "left"
    ).select("set_hash", F.coalesce("component", "doc").alias("component"))
    one_id = named.groupBy("set_hash").agg(F.min("component").alias("component"))
    return (
        sketched.select("doc", "n_shingles", "set_hash")
        .join(one_id, "set_hash", "left")
        .select(
            F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
            "n_shingles",
            F.nullif(F.coalesce("component", "doc"), F.lit(NO_ID)).alias("component_id"),
            (F.coalesce("component", "doc") == F.col("doc")).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns."""
    found = written(near_duplicates(docs, width, percent), "components")
    dropped = found.filter("not kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).distinct()
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"),
    )
    return by_ids(keyed, dropped, "id", "left_anti").select("row.*")
