"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import whole
from newsloom.session import written

BLOCK_BYTES = 1_000_000
TEMPERATURE = 0.5
SHARES = 2**40  # integer weights add up to about so much: over a billion blocks rounding moves no share by a block
NO_ID = -(2**63)  # stands for a NULL id
SEED = 17

ENTRY = "source string, doc long, text_key long, size long, part int, before long"
PLAN = "of string, nth long, slot long, release long, deadline long"


def integer_weights(weights: Mapping, shares: int = SHARES) -> dict:
    """Weights as whole numbers, at least one, in proportion as close as ``shares`` allows."""
    total = sum(weights.values())
    return {name: max(1, round(shares * weight / total)) for name, weight in weights.items()}


class Fluid:
    """The ideal mixture, in which all sources that are left flow at once by their weights.

    Time is counted in blocks. A source with weight w has served v * w blocks at the virtual time v, until it is used up;
    so the time at v is the sum over the sources of min(blocks, v * w), which is linear between the ends of sources.
    """

    def __init__(self, blocks: Mapping, weights: Mapping):
        ends = sorted((Fraction(n, weights[name]), n, weights[name]) for name, n in blocks.items())
        self.ends = [(n, w) for _, n, w in ends]
        used = [0, *accumulate(n for _, n, _ in ends)]
        flow = [0, *accumulate(w for _, _, w in ends)]
        self.parts = [(n, flow[-1] - w) for n, w in zip(used, flow)]

    def time(self, blocks: int, weight: int, part: int = 0) -> tuple[int, int, int]:
        """When a source with this weight has served so many blocks, rounded down and up; and the part of the time, which
        may be given from where to look."""
        while self.ends[part][0] * weight < blocks * self.ends[part][1]:
            part += 1
        used, flow = self.parts[part]
        whole, rest = divmod(blocks * flow, weight)
        return used + whole, used + whole + (rest > 0), part


def schedule(blocks: Mapping, weights: Mapping) -> Iterator[tuple]:
    """(source, block, slot, release, deadline) of all blocks, by slot: earliest deadline first.

    Block k of a source may start when the ideal mixture begins to serve it, rounded down, and is due when that
    has served it, rounded up. No stretch of slots has more blocks released and due in it than slots, so every block meets its
    deadline: at any slot a source is less than one block from its share among the sources that are not used up.
    Memory holds one block of each source.
    """
    fluid = Fluid(blocks, weights)
    order = sorted(blocks, key=lambda name: (-weights[name], name is None, name))
    waiting = [(0, i, 0, 0) for i in range(len(order))]
    due: list = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            release, i, k, part = heapq.heappop(waiting)
            later, deadline, part = fluid.time(k + 1, weights[order[i]], part)
            heapq.heappush(due, (deadline, i, k, release, later, part))
        deadline, i, k, release, later, part = heapq.heappop(due)
        yield order[i], k, slot, release, deadline
        if k + 1 < blocks[order[i]]:
            heapq.heappush(waiting, (later, i, k + 1, part))


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The schedule of the sources (source, blocks, weight), in parts."""
    sources = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
    if not sources:
        return
    blocks, weights = {s: n for s, n, _ in sources}, integer_weights({s: w for s, _, w in sources})
    rows = schedule(blocks, weights)
    kinds = [pa.string(), *[pa.int64()] * 4]
    while part := list(islice(rows, 10_000)):
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=["of", "nth", "slot", "release", "deadline"]
        )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by source: the bytes of the source before each row."""
    part = TaskContext.get().partitionId()
    last, carried, started = None, 0, False
    for batch in batches:
        names, sizes = batch.column("source").to_pylist(), batch.column("size").to_pylist()
        before = []
        for name, size in zip(names, sizes):
            if not started or name != last:
                last, carried, started = name, 0, True
            before.append(carried)
            carried += size
        yield pa.record_batch(
            [*batch.columns, pa.array([part] * len(names), pa.int32()), pa.array(before, pa.int64())],
            names=[*batch.schema.names, "part", "before"],
        )


def _keys() -> list:
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.xxhash64(whole()).alias("text_key")]


def mix_slots(
    docs: DataFrame, weights: Mapping | None = None, block_bytes: int = BLOCK_BYTES, seed: int = SEED
) -> DataFrame:
    """(doc, text_key, source, block, slot, release, deadline), one row per distinct document.

    Each source's documents, in a random order fixed by ``seed``, are cut into blocks of
    ``block_bytes`` of text; a document belongs to the block in which it starts. ``weights`` gives the target
    of each source; sources that it lacks, and all without it, weigh as their bytes to the power 0.5. The order
    of blocks is the Pfair schedule: at any slot every source is less than one
    block from its target among the sources that are not yet used up. No document is dropped or repeated.

    Running sums come from a range sort by source, so a source that holds most rows spreads over
    many tasks; only sums per partition and source meet. Weights are whole shares of ``SHARES``, so the schedule
    follows the targets, not a rounding of them. It has one row per block, a millionth of the bytes, which one task streams out,
    holding one block of each source; the documents find their blocks by a join. There may be any number of sources.
    """
    entries = (
        docs.select("source", *_keys(), F.octet_length(whole()).cast("long").alias("size"))
        .groupBy("source", "doc", "text_key")
        .agg(F.sum("size").alias("size"))
    )
    # Written first, so that the sort's sample does not read the texts again.
    entries = written(entries.select(F.col("source").cast("string"), "doc", "text_key", "size"), "entries")
    order = ["source", F.xxhash64(F.lit(seed), "doc", "text_key"), "doc", "text_key"]
    running = written(
        entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, ENTRY), "running"
    )
    # At most one row per partition and per source.
    sums = written(running.groupBy("source", "part").agg(F.sum("size").alias("n")), "sums")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift")
    )
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    sources = _weighted(totals, weights).select(
        "source", F.greatest(F.ceil(F.col("n") / block_bytes), F.lit(1)).alias("blocks"), "weight"
    )
    plan = written(sources.coalesce(1).mapInArrow(_plan, PLAN), "plan")
    placed = running.join(shifts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    # Empty documents at the very end of a source stay in its last block.
    last = F.col("before") + F.col("shift")
    blocked = placed.select(
        "doc", "text_key", "source", F.floor(F.greatest(last - (F.col("size") == 0).cast("int"), F.lit(0)) / block_bytes).alias("block")
    )
    return blocked.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nth"))).select(
        "doc", "text_key", "source", "block", "slot", "release", "deadline"
    )


def _weighted(totals: DataFrame, weights: Mapping | None) -> DataFrame:
    """(source, n, weight) of (source, n): given weights, and bytes to the power 0.5 in the scale of these."""
    own = F.greatest("n", F.lit(1)).cast("double") ** TEMPERATURE
    if not weights:
        return totals.withColumn("weight", own)
    given = totals.sparkSession.createDataFrame(
        [(name, float(weight)) for name, weight in weights.items()], "name string, given double"
    )
    both = totals.withColumn("own", own).join(given, F.col("source").eqNullSafe(F.col("name")), "left")
    scale = both.filter("given is not null").agg(F.sum("own").alias("own")).first().own
    scale = sum(weights.values()) / scale if scale else 1.0
    return both.select("source", "n", F.coalesce("given", scale * F.col("own")).alias("weight"))


def mix(
    docs: DataFrame, weights: Mapping | None = None, block_bytes: int = BLOCK_BYTES, seed: int = SEED
) -> DataFrame:
    """(row: the columns of ``docs``, block, slot, release, deadline), a row per row of ``docs``.

    Sorted by ``slot`` the rows are the mixture. NULL text has no bytes; documents
    without source form one source. Repeated rows share their place. An empty table
    gives an empty result.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys())
    slots = mix_slots(docs, weights, block_bytes, seed).withColumnRenamed("source", "of")
    own = F.col("row.source").cast("string").eqNullSafe(F.col("of"))
    return (
        keyed.alias("k")
        .join(slots.alias("s"), (F.col("k.doc") == F.col("s.doc")) & (F.col("k.text_key") == F.col("s.text_key")) & own)
        .select("row", "block", "slot", "release", "deadline")
    )
