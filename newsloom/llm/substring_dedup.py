"""Passages repeated across documents, by windows of words and a count-min prefilter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.llm.columns import whole
from newsloom.llm.hashing import GOLDEN, WordHashes, mix, packed, unpacked, windows

WIDTH = 13
DEPTH = 2  # rows of the sketch
CELLS_PER_WINDOW = 3
LEAST_CELLS, MOST_CELLS = 2**22, 2**29  # of a row, or of each part of it
BLOCK = 2**24  # cells merged at once
BYTES_PER_WORD = 6
FLUSH = 1_000_000  # words in a bin of texts
ASKED = 1_000_000  # windows in a shard of the exact pass
NO_ID = -(2**63)  # stands for a NULL id
SLOT = 2**32  # places of a second text under the same id begin here

BLOCKS = "row int, block int, bin int, cells binary"
PLANES = "bin int, row int, block int, bits binary"
ASKS = "shard int, bin int, hashes binary, docs binary, places binary"
REMOVED = "bin int, docs binary, places binary"


def _differences(sorted_cells: np.ndarray) -> bytes:
    return packed(np.diff(sorted_cells, prepend=0).astype(np.uint32))


def _cells(hashes: np.ndarray, row: int, cells: int, n_parts: int) -> np.ndarray:
    """A part of the row by hash, and a cell in it."""
    with np.errstate(over="ignore"):
        cell = mix(hashes + np.uint64(row + 1) * GOLDEN) % np.uint64(cells)
    return (hashes >> np.uint64(20)) % np.uint64(n_parts) * np.uint64(cells) + cell


def _blocks(cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted cells by block: (blocks, the cells of each within it)."""
    block = cells // np.uint64(BLOCK)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(cells) else np.zeros(0, np.int64)
    return block[starts], [part % np.uint64(BLOCK) for part in np.split(cells, starts[1:])] if len(cells) else []


def _table(schema: str, columns) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(columns) or [()] * len(fields)
    return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns)})


def _bodies(texts: pa.Table, text: str) -> list[bytes]:
    column = texts.column("row").combine_chunks().field(text).cast(pa.binary())
    return [body or b"" for body in column.to_pylist()]


def _window_rows(texts: pa.Table, text: str, width: int, hashes: WordHashes) -> tuple[np.ndarray, ...]:
    """Of a bin's texts: the document, place and hash of each window."""
    docs, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for doc, slot, body in zip(texts.column("doc").to_pylist(), texts.column("slot").to_pylist(), _bodies(texts, text)):
        all_of = windows(hashes.of(body.split()), width)
        docs.append(np.full(len(all_of), doc, np.int64))
        places.append(np.arange(len(all_of), dtype=np.int64) + slot * SLOT)
        found.append(all_of)
    return tuple(map(np.concatenate, (docs, places, found)))


def _sketch(texts: pa.Table, text: str, width: int, hashes: WordHashes, cells: int, n_parts: int) -> pa.Table:
    """The cells that a bin's windows hit, by blocks."""
    _, _, found = _window_rows(texts, text, width, hashes)
    bin_, rows = texts.column("bin")[0].as_py(), []
    for row in range(DEPTH):
        # Faster than np.unique, which hashes.
        hit = np.sort(_cells(found, row, cells, n_parts))
        for block, hit in zip(*_blocks(hit[np.r_[True, hit[1:] != hit[:-1]]] if len(hit) else hit)):
            rows.append((row, int(block), bin_, _differences(hit)))
    return _table(BLOCKS, zip(*rows))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by row and block: for each bin one bit for each of its cells there, hit by another bin too."""

    def answered(row: int, block: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BLOCK, np.uint8)
        for _, cells in parts:
            hit = np.cumsum(unpacked(cells, np.uint32))
            counts[hit] = np.minimum(counts[hit] + 1, 2)
        rows = []
        for bin_, cells in parts:
            bits = np.packbits(counts[np.cumsum(unpacked(cells, np.uint32))] > 1)
            rows.append((bin_, row, block, zlib.compress(bits.tobytes(), 1)))
        yield from _table(PLANES, zip(*rows)).to_batches()

    key, parts = None, []
    for batch in batches:
        for row, block, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if (row, block) != key and parts:
                yield from answered(*key, parts)
                parts = []
            key = row, block
            parts.append(tuple(part))
    if parts:
        yield from answered(*key, parts)


def _lowest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (hash, document), and in that order each hash's smallest document."""
    order = np.lexsort((docs, hashes))
    sorted_hashes = hashes[order]
    starts = np.flatnonzero(np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]])
    return order, np.repeat(docs[order][starts], np.diff(np.r_[starts, len(order)]))


def _asks(
    texts: pa.Table, planes: pa.Table, text: str, width: int, hashes: WordHashes, cells: int, n_parts: int, shards: int
) -> pa.Table:
    """Of a bin's windows estimated repeated: those that a smaller document of the bin starts (without
    hashes, to a shard beyond the others), and of the rest one of each hash and document, by shards."""
    docs, places, found = _window_rows(texts, text, width, hashes)
    bits = {(row, block): data for _, row, block, data in zip(*(column.to_pylist() for column in planes.columns))}
    likely = np.ones(len(found), bool)
    for row in range(DEPTH):
        hit, at, n = np.unique(_cells(found, row, cells, n_parts), return_inverse=True, return_counts=True)
        often = [n > 1]
        elsewhere = [
            np.unpackbits(np.frombuffer(zlib.decompress(bits[row, int(block)]), np.uint8), count=len(of)).astype(bool)
            for block, of in zip(*_blocks(hit))
        ]
        if elsewhere:
            often.append(np.concatenate(elsewhere))
        likely &= np.logical_or.reduce(often)[at]
    docs, places, found = docs[likely], places[likely], found[likely]
    rows = []
    if len(found):
        bin_ = texts.column("bin")[0].as_py()
        order, low = _lowest(found, docs)
        docs, places, found = docs[order], places[order], found[order]
        later = docs > low
        if later.any():
            rows.append((shards + int(found[0] % np.uint64(shards)), bin_, None, packed(docs[later]), packed(places[later])))
        docs, places, found = docs[~later], places[~later], found[~later]
        shard = (found >> np.uint64(40)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            rows.append((s, bin_, found[mine].tobytes(), packed(docs[mine]), packed(places[mine])))
    return _table(ASKS, zip(*rows))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by shard: the windows that start in a smaller document too, one
    row per shard and bin."""

    def answered(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = [unpacked(d, np.int64) for _, _, d, _ in parts]
        bins = np.repeat([of for of, *_ in parts], [len(d) for d in found])
        docs = np.concatenate(found)
        places = np.concatenate([unpacked(p, np.int64) for *_, p in parts])
        if parts[0][1] is not None:  # else decided before
            order, low = _lowest(np.concatenate([np.frombuffer(h, np.uint64) for _, h, _, _ in parts]), docs)
            bins, docs, places = bins[order], docs[order], places[order]
            later = docs > low
            bins, docs, places = bins[later], docs[later], places[later]
        order = np.lexsort((places, docs, bins))
        bins, docs, places = bins[order], docs[order], places[order]
        starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else []
        rows = [
            (int(bins[a]), packed(docs[a:b]), packed(places[a:b])) for a, b in zip(starts, [*starts[1:], len(bins)])
        ]
        yield from _table(REMOVED, zip(*rows)).to_batches()

    shard, parts = None, []
    for batch in batches:
        for of, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if of != shard and parts:
                yield from answered(parts)
                parts = []
            shard = of
            parts.append(tuple(part))
    if parts:
        yield from answered(parts)


def _kept(texts: pa.Table, removed: pa.Table, text: str, width: int) -> pa.Table:
    """The rows of a bin without the words of the windows removed."""
    docs, places = (
        np.concatenate([np.zeros(0, np.int64), *(unpacked(part, np.int64) for part in removed.column(name).to_pylist())])
        for name in ("docs", "places")
    )
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    own = np.array(texts.column("doc").to_pylist(), np.int64)
    bounds = zip(np.searchsorted(docs, own), np.searchsorted(docs, own, "right"))
    bodies, n_words, n_removed = [], [], []
    for body, slot, (a, b) in zip(_bodies(texts, text), texts.column("slot").to_pylist(), bounds):
        found = body.split()
        n_words.append(len(found))
        n_removed.append(0)
        if a < b:
            at = places[a:b]
            at = at[at // SLOT == slot] % SLOT
            edges = np.zeros(len(found) + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + width, -1)
            stays = np.cumsum(edges[:-1]) == 0
            n_removed[-1] = len(found) - int(stays.sum())
            found = [word for word, stay in zip(found, stays) if stay]
        bodies.append(b" ".join(found).decode())
    rows = texts.column("row").combine_chunks()
    fields = list(rows.type)
    columns = [pa.array(bodies, field.type) if field.name == text else rows.field(i) for i, field in enumerate(fields)]
    return pa.table(
        {
            "row": pa.StructArray.from_arrays(columns, fields=fields),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
        }
    )


def drop_repeated_passages(docs: DataFrame, width: int = WIDTH, most_cells: int = MOST_CELLS) -> DataFrame:
    """``docs`` without the words of passages that a smaller document has too: (row: its
    columns, with the kept words joined by spaces as ``text``; n_words, n_removed).

    A window is ``width`` consecutive words of one document. A word goes when it
    lies in a window whose words also start in a document with a smaller id, all judged on the input.

    The texts are shuffled once, into bins by document; every step reads that exchange. Each bin sends the cells that
    its windows hit in a count-min sketch of two rows that saturate at two, block by block, and gets a bit for each back: hit
    by another bin too. Windows with a cell hit once only are unique. The others, all repeated ones among them, are grouped
    exactly: within a bin first, so that a window found in many documents leaves it once, then by shards of the hash. What
    is removed goes back to the bins. Rows of the sketch have three cells a window, in parts by hash of up to
    ``most_cells``; no task holds more than a block of it, and the driver nothing.

    NULL or empty text has no words. Rows with one id are one document to the others; their
    texts are cut each by its own places. Rows without id count as the smallest
    document. An empty table gives an empty result.
    """
    body = whole()
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(
        columns.alias("row"),
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(body).alias("text_key"),
        F.octet_length(body).alias("size"),
    )
    # Ids with several texts, seldom any: each text has a slot of its own.
    several = (
        keyed.groupBy("doc").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).filter("a <> b").select("doc")
    )
    if several.isEmpty():
        keyed = keyed.withColumn("slot", F.lit(0).cast("long"))
    else:
        texts_of = keyed.join(several, "doc", "left_semi").select("doc", "text_key").distinct()
        slots = texts_of.withColumn(
            "slot", F.row_number().over(Window.partitionBy("doc").orderBy("text_key")).cast("long")
        )
        keyed = keyed.join(slots, ["doc", "text_key"], "left").withColumn("slot", F.coalesce("slot", F.lit(0)))
    estimate = (keyed.agg(F.sum("size")).first()[0] or 0) // BYTES_PER_WORD
    n_parts = max(1, ceil(CELLS_PER_WINDOW * estimate / most_cells))
    cells = min(most_cells, max(LEAST_CELLS, CELLS_PER_WINDOW * estimate // n_parts))
    shards = max(ceil(estimate / ASKED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_bins = max(1, ceil(estimate / FLUSH))
    # Nothing is removed of rows without id, so they may be in any bin.
    home = F.when(F.col("doc") == NO_ID, F.xxhash64("text_key")).otherwise(F.xxhash64("doc"))
    texts = keyed.select(F.pmod(home, F.lit(n_bins)).cast("int").alias("bin"), "doc", "slot", "row").repartition(n_bins, "bin")
    text, hashes = next(name for name in docs.columns if name.lower() == "text"), WordHashes()
    planes = (
        texts.groupBy("bin")
        .applyInArrow(lambda table: _sketch(table, text, width, hashes, cells, n_parts), BLOCKS)
        .repartition("row", "block").sortWithinPartitions("row", "block")
        .mapInArrow(_merged, PLANES)
        .repartition(n_bins, "bin")
    )
    removed = (
        texts.groupBy("bin").cogroup(planes.groupBy("bin"))
        .applyInArrow(lambda table, bits: _asks(table, bits, text, width, hashes, cells, n_parts, shards), ASKS)
        .repartition(shards, "shard").sortWithinPartitions("shard")
        .mapInArrow(_answers, REMOVED)
        .repartition(n_bins, "bin")
    )
    kept = StructType(
        [StructField("row", docs.schema), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    )
    return texts.groupBy("bin").cogroup(removed.groupBy("bin")).applyInArrow(lambda table, gone: _kept(table, gone, text, width), kept)
