"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import whole
from newsloom.operators.order import numbered
from newsloom.session import written

CAPACITY = 1024
END_ID = 2
CACHED_CHUNKS = 300_000
LONGEST_CACHED = 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def ranks_file() -> str:
    """The byte-level BPE with 50k merges, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def special_ids() -> dict[str, int]:
    """The special tokens of the same vocabulary. Their strings in a text are these tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, as the vocabulary's own tokenizer gives them.

    Texts are cut at strings of special tokens. The merges never cross the place before a single space, so a text is cut
    there and repeated pieces are looked up. Texts where a space meets other
    white space are encoded as they are.
    """

    def __init__(self, path: str, specials: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        specials = special_ids() if specials is None else specials
        self.specials = {text: id.to_bytes(4, "little") for text, id in specials.items()}
        longest_first = sorted(map(re.escape, specials), key=len, reverse=True)
        self.cuts = re.compile(f"({'|'.join(longest_first)})") if specials else None
        self.known: dict[str, bytes] = {}
        self.mixed = re.compile(r" (?:\s|$)")

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def spaced(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.plain(" " + chunk)
            if len(chunk) <= LONGEST_CACHED:
                if len(self.known) > CACHED_CHUNKS:
                    self.known.clear()
                self.known[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.cuts is None:
            return self.between(text)
        text, *more = self.cuts.split(text)
        rest = (self.specials[special] + self.between(part) for special, part in zip(more[::2], more[1::2]))
        return self.between(text) + b"".join(rest)

    def between(self, text: str) -> bytes:
        if self.mixed.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.spaced, rest))


def _pieces(
    batches: Iterator[pa.RecordBatch],
    path: str,
    specials: dict[str, int],
    capacity: int,
    end_id: int,
    keep_ids: bool,
    slotted: bool,
) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, specials)
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        rows = []
        for doc, text, *slot in zip(*(column.to_pylist() for column in batch.columns)):
            ids = encoder.ids(text) + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = ids[4 * a : 4 * b]
                rows.append((doc, piece, a, b - a, zlib.crc32(part), *[part] * keep_ids, *slot))
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + ["slot"] * slotted
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids + [pa.int64()] * slotted
        columns = list(zip(*rows)) or [()] * len(types)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


class Run(NamedTuple):
    """``count`` documents of one length, from ``rank`` on, go to bins from ``bin`` on, ``per_bin`` to each,
    the first at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    per_bin: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the documents of each length go, the longest first.

    One step a length. The documents of that length sweep the gaps upwards from their own length:
    the tightest gap that fits is filled first, and bins are opened when none is left. Bins with
    equal gaps lie in runs, so a step costs as much as the runs it touches,
    whatever the number of documents; ranks settle who gets which bin.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan: list[Run] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                plan.append(Run(length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # too few to fill one more bin
                plan.append(Run(length, rank, left, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, n - full)
    return plan


def _placed(batches: Iterator[pa.RecordBatch], plan: list[Run]) -> Iterator[pa.RecordBatch]:
    columns = np.array(plan, np.int64).reshape(-1, len(Run._fields)).T
    lengths = columns[0]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.zeros(len(length), np.int64)
        for value in np.unique(length):
            runs = np.flatnonzero(lengths == value)
            mine = length == value
            at[mine] = runs[np.searchsorted(columns[1][runs], rank[mine], "right") - 1]
        _, first, _, bin_, per_bin, offset = (c[at] for c in columns)
        inside = rank - first
        keep = [name for name in batch.schema.names if name != "rank"]
        yield pa.record_batch(
            [batch.column(name) for name in keep]
            + [pa.array(bin_ + inside // per_bin), pa.array(offset + inside % per_bin * length)],
            names=[*keep, "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    path: str | None = None,
    end_id: int = END_ID,
    keep_ids: bool = False,
    slot: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ``ids``, little-endian 32-bit, with ``keep_ids``).

    A document is its token ids followed by ``end_id``. One that is longer than ``capacity`` is cut into
    pieces of that length, the first shorter if need be. Pieces are packed into as few
    sequences as best-fit-decreasing needs.

    Pieces are range-sorted by length over all tasks, and each gets its rank among those of its
    length from per-partition counts. Gaps are matched in bulk steps over runs of equal
    lengths (``best_fit``); their number depends on ``capacity`` alone. Every task then
    finds the sequence and offset of its own pieces by their ranks. So nothing that
    grows with the documents passes one task or the driver, and the tokens are read once.

    With ``slot``, a column of whole numbers, the sequences are numbered by the slot of their longest piece, and
    pieces of one length are placed in the order of their slots. So read by ``sequence_id`` the sequences follow the
    slots; the pieces that fill their gaps may come from any slot. The sequences are as few as without it.

    NULL or empty text is the end id alone. Repeated rows are packed each. An empty table gives an
    empty result. Other columns are ignored.
    """
    path, specials = path or ranks_file(), special_ids()
    slotted = slot is not None
    schema = PIECE + (", ids binary" if keep_ids else "") + (", slot long" if slotted else "")
    slots = [F.col(f"`{slot}`").cast("long").alias("slot")] if slotted else []
    pieces = docs.select("doc_id", whole().alias("text"), *slots).mapInArrow(
        lambda batches: _pieces(batches, path, specials, capacity, end_id, keep_ids, slotted), schema
    )
    pieces = written(pieces, "pieces")
    order = [F.col("length").desc(), *["slot"] * slotted, F.col("doc_id"), F.col("piece")]
    # The id holds the partition in its upper bits and the place in it below.
    numbered = written(
        pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()),
        "sorted",
    ).withColumns({"part": F.shiftright("row", 33), "place": F.col("row").bitwiseAND(F.lit(2**33 - 1))})
    # One row per length and partition that holds it: at most capacity + partitions.
    counted = numbered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select(
        "length", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    plan = best_fit({r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ranked = numbered.join(F.broadcast(shifts), ["length", "part"]).withColumn("rank", F.col("place") + F.col("shift"))
    placed = ranked.select(*pieces.columns, "rank").mapInArrow(
        lambda batches: _placed(batches, plan), schema + ", sequence_id long, offset long"
    )
    return _by_slots(placed) if slotted else placed


def _by_slots(placed: DataFrame) -> DataFrame:
    """The sequences numbered by the slot of their longest piece, which is the one at offset 0."""
    placed = written(placed, "placed")
    first = placed.filter("offset = 0").select("sequence_id", "slot")
    # A sequence's old number spreads what shares a slot over it.
    order = [F.col("slot"), F.xxhash64("sequence_id"), F.col("sequence_id")]
    renamed = numbered(first, order).select("sequence_id", (F.col("number") - 1).alias("place"))
    return placed.join(renamed, "sequence_id").select(
        *[F.col("place").alias(c) if c == "sequence_id" else F.col(c) for c in placed.columns if c != "slot"]
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence is at most ``capacity`` long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
