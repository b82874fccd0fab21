"""Documents that share most of their word n-grams: a blocked sparse matrix product with size bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import whole
from newsloom.llm.components import connected_components
from newsloom.llm.hashing import WordHashes, by_ids, packed, shingle_set, texts, unpacked
from newsloom.session import written

WIDTH = 5
PERCENT = 80
BLOCK_ENTRIES = 500_000  # of the matrix, in a block of sets
SHARD_ENTRIES = 1_500_000  # of the blocks' columns, counted at a time
SHARDS_PER_TASK = 8
SPARE_BITS = 12  # of a column, beyond those that number all entries
NTH = 256  # of equal columns of one set
MOST_BITS = 54  # a column and its NTH are a long
PARTNERS = 128  # sets that are compared with one copy of a row's set
GROWTH = 256  # a block of rows is so many times the one before
PARITIES = 512  # bits of a set: whether it has an odd number of columns of each kind
NO_ID = -(2**63)  # stands for a NULL id

BLOCK = "block long, rows binary, sizes binary, columns binary"
ASK = "shard int, block long, columns binary, counts binary"
ANSWER = "block long, columns binary, counts binary"
BITS = [f"p{i}" for i in range(PARITIES // 64)]
ENTRY = "col long, df long, row binary, n long, place long, " + ", ".join(f"{name} long" for name in BITS)
COLUMNS = [part.split()[0] for part in ENTRY.split(", ")]


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sizes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for rows in texts(batches):
        sets = [shingle_set(text, hashes, width) for _, text in rows]
        columns = [
            pa.array([doc for doc, _ in rows], pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
        ]
        yield pa.record_batch(columns, names=["doc", "n_shingles", "row"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of the matrix in blocks: each set's columns, ascending. A column is the upper bits of an n-gram's hash;
    two n-grams of a set with equal bits are two entries, so no overlap is ever counted too small."""
    part, hashes = TaskContext.get().partitionId(), WordHashes()
    nth, sets, size = 0, [], 0

    def block() -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        columns = np.concatenate(sets) >> np.uint64(64 - bits)
        # Differences within a set: a byte or two less than the columns themselves.
        steps = np.diff(columns, prepend=np.uint64(0))
        starts = np.cumsum(sizes) - sizes
        steps[starts] = columns[starts]
        values = ((part << 32) + nth, b"".join(map(_digest, sets)), packed(sizes), packed(steps))
        kinds = [pa.int64()] + [pa.binary()] * 3
        return pa.record_batch(
            [pa.array([v], t) for v, t in zip(values, kinds)], names=["block", "rows", "sizes", "columns"]
        )

    for rows in texts(batches):
        for _, text in rows:
            found = shingle_set(text, hashes, width)
            if not len(found):
                continue
            sets.append(found)
            size += len(found)
            if size >= BLOCK_ENTRIES:
                yield block()
                nth, sets, size = nth + 1, [], 0
    if sets:
        yield block()


def _columns(sizes: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's sizes and its columns, set after set."""
    sizes, steps = unpacked(sizes, np.int64), unpacked(columns, np.uint64)
    running = np.cumsum(steps)
    starts = np.cumsum(sizes) - sizes
    before = np.r_[np.uint64(0), running][starts]
    return sizes, running - np.repeat(before, sizes)


def _asks(batches: Iterator[pa.RecordBatch], shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct columns with their counts, by shards that are ranges of columns."""
    for batch in batches:
        for block, sizes, columns in zip(*(c.to_pylist() for c in batch.columns)):
            distinct, counts = np.unique(_columns(sizes, columns)[1], return_counts=True)
            of = ((distinct >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            rows = [
                (int(of[a]), block, packed(np.diff(distinct[a:b], prepend=np.uint64(0))), packed(counts[a:b].astype(np.uint32)))
                for a, b in zip(cuts, [*cuts[1:], len(of)])
            ]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["shard", "block", "columns", "counts"]
            )


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by shard: to each block its columns that occur twice or more anywhere, with their counts."""

    def answered(parts: list[tuple]) -> pa.RecordBatch:
        columns = [np.cumsum(unpacked(c, np.uint64)) for _, c, _ in parts]
        counts = np.concatenate([unpacked(n, np.uint32) for _, _, n in parts])
        _, of = np.unique(np.concatenate(columns), return_inverse=True)
        totals = np.bincount(of, weights=counts).astype(np.int64)[of]
        rows, at = [], 0
        for (block, _, _), own in zip(parts, columns):
            total = totals[at : at + len(own)]
            at += len(own)
            shared = total > 1
            if shared.any():
                rows.append((block, packed(np.diff(own[shared], prepend=np.uint64(0))), packed(total[shared])))
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        found = list(zip(*rows)) or [()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(found, kinds)], names=["block", "columns", "counts"])

    last, parts = None, []
    for batch in batches:
        for shard, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != last and parts:
                yield answered(parts)
                parts = []
            last = shard
            parts.append(tuple(part))
    if parts:
        yield answered(parts)


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The matrix entries that the product needs. With the columns of a set in order of their counts, two
    sets that are similar enough share one of their first n - ceil(threshold * n) + 1. Of these, columns that
    occur once meet nobody and are left out."""
    for batch in batches:
        for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            sizes, columns = _columns(block["sizes"], block["columns"])
            df = np.ones(len(columns), np.int64)
            for answer in block["answers"]:
                known = np.cumsum(unpacked(answer["columns"], np.uint64))
                at = np.searchsorted(known, columns)
                at[at == len(known)] = 0
                hit = known[at] == columns
                df[hit] = unpacked(answer["counts"], np.int64)[at[hit]]
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # The nth of equal columns of a set meets the nth of another's.
            again = np.zeros(len(of), bool)
            again[1:] = (columns[1:] == columns[:-1]) & (place[1:] > 0)
            nth = np.arange(len(of)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(of))))
            order = np.lexsort((columns, df, of))
            prefix = sizes - _least(sizes, percent) + 1
            ordered = (place < prefix[of]) & (df[order] > 1)
            kept = order[ordered]
            kinds = np.bincount(of * PARITIES + (columns % np.uint64(PARITIES)).astype(np.int64), minlength=len(sizes) * PARITIES)
            parities = np.packbits((kinds & 1).astype(np.uint8)).view(np.int64).reshape(len(sizes), -1)[of[kept]]
            rows = block["rows"]
            digests = [rows[16 * i : 16 * i + 16] for i in range(len(sizes))]
            yield pa.record_batch(
                [
                    pa.array(columns[kept].astype(np.int64) * NTH + np.minimum(nth[kept], NTH - 1)),
                    pa.array(df[kept]),
                    pa.array(digests, pa.binary()).take(pa.array(of[kept])),
                    pa.array(sizes[of[kept]]),
                    pa.array(place[ordered]),
                    *map(pa.array, np.ascontiguousarray(parities.T)),
                ],
                names=COLUMNS,
            )


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100): the overlap that a set of n needs with any other."""
    return -(-percent * n // 100)


def _entries(source: DataFrame, n_entries: int, width: int, percent: int) -> DataFrame:
    """The entries (col, df, row, n, place, parities) of the sets' prefixes. Blocks send their distinct columns to shards and
    get back those that are shared: a column that every set has is one row per block there."""
    spark = source.sparkSession
    bits = min(max(n_entries.bit_length() + SPARE_BITS, 32), MOST_BITS)
    blocks = written(source.mapInArrow(lambda x: _blocks(x, width, bits), BLOCK), "blocks")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n_entries // SHARD_ENTRIES), least)
    answers = (
        blocks.select("block", "sizes", "columns")
        .mapInArrow(lambda x: _asks(x, shards, bits), ASK)
        .repartition(max(least, -(-shards // SHARDS_PER_TASK)), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_answers, ANSWER)
        .groupBy("block")
        .agg(F.collect_list(F.struct("columns", "counts")).alias("answers"))
    )
    # A block without answers shares nothing.
    return written(
        blocks.join(answers, "block").mapInArrow(lambda x: _prefixes(x, percent), ENTRY).distinct(), "entries"
    )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for rows in texts(batches):
        sets = [s for s in (shingle_set(text, hashes, width) for _, text in rows) if len(s)]
        columns = [list(map(_digest, sets)), [s.tobytes() for s in sets]]
        yield pa.record_batch([pa.array(c, pa.binary()) for c in columns], names=["row", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by chunk, the row's own set first: the partners that are similar enough on full sets."""
    own = np.zeros(0, np.uint64)
    for batch in batches:
        links = []
        for a, b, shingles in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles"))):
            found = np.frombuffer(shingles, np.uint64)
            if b is None:
                own = found
                continue
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            both = int((own[at] == found).sum())
            if 100 * both >= percent * (len(own) + len(found) - both):
                links.append((a, b))
        columns = list(zip(*links)) or [()] * 2
        yield pa.record_batch([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. ``a`` may have any number of partners: they are cut into chunks, and a chunk
    streams past one copy of its set."""
    chunks = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("n_chunks")), "chunks")
    mine = (
        chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("nth"))
        .join(sets.withColumnRenamed("row", "a"), "a")
        .select("a", "nth", F.lit(None).cast("binary").alias("b"), "shingles")
    )
    others = (
        pairs.join(chunks, "a")
        .select("a", F.pmod(F.xxhash64("b"), "n_chunks").alias("nth"), "b")
        .join(sets.withColumnRenamed("row", "b"), "b")
        .select("a", "nth", "b", "shingles")
    )
    return (
        mine.unionByName(others)
        .repartition("a", "nth")
        .sortWithinPartitions("a", "nth", F.col("b").asc_nulls_first())
        .mapInArrow(lambda x: _verified(x, percent), "a binary, b binary")
    )


def _block_of_rows(entries: DataFrame, most: int) -> DataFrame:
    """Rows that are among the ``most`` first in their most common open column. The most common column of all
    has some of them, so every block gets on. First are rows whose columns are common: of near copies those with
    the fewest changes, to which most others are similar."""
    home = entries.groupBy("row").agg(
        F.max_by("col", F.struct("df", "col")).alias("col"), (F.sum("df") / F.max("n")).alias("weight")
    )
    nth = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("weight"), "row"))
    return home.select("row", nth.alias("nth")).filter(F.col("nth") <= most).select("row")


def _product(entries: DataFrame, block: DataFrame, percent: int) -> DataFrame:
    """Pairs (a of ``block``, b) of different parts whose overlap may reach the bound.

    In the order of columns, two sets share at most what lies before, and what lies after, each column that
    they share; and every kind of columns of which one has an odd and the other an even number is a column that they do not
    share. A product beyond these bounds is discarded at once. The others are added up over all columns
    of the pair; beyond its prefix a set can add what is left of it at most.
    """
    flagged = written(
        entries.join(block.withColumn("inside", F.lit(True)), "row", "left").withColumn(
            "inside", F.coalesce("inside", F.lit(False))
        ),
        "flagged",
    )
    mine = flagged.filter("inside").select(
        "col",
        F.col("row").alias("a"),
        F.col("n").alias("na"),
        F.col("part").alias("pa"),
        F.col("place").alias("ia"),
        *[F.col(name).alias(f"a_{name}") for name in BITS],
    )
    others = flagged.select(
        "col",
        F.col("row").alias("b"),
        F.col("n").alias("nb"),
        F.col("part").alias("pb"),
        F.col("place").alias("ib"),
        F.col("inside").alias("also"),
        *[F.col(name).alias(f"b_{name}") for name in BITS],
    )
    needed = F.expr(f"((na + nb) * {percent} + {99 + percent}) div {100 + percent}")
    fits = (F.col("pa") != F.col("pb")) & (~F.col("also") | (F.col("a") < F.col("b")))
    fits &= 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    fits &= F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= needed
    odd = sum(F.bit_count(F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}"))) for name in BITS)
    fits &= F.col("na") + F.col("nb") - odd >= 2 * needed
    rest = F.expr(f"(greatest(na, nb) * {percent} + 99) div 100 - 1")
    return (
        mine.join(others.withColumnRenamed("col", "col_"), (F.col("col") == F.col("col_")) & fits)
        .groupBy("a", "b", "na", "nb")
        .agg(F.count(F.lit(1)).alias("overlap"))
        .filter(F.col("overlap") + rest >= needed)
        .select("a", "b")
    )


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set holds its distinct n-grams of ``width`` words, A-Z in lower case; a shorter text is one
    n-gram, an empty one has an empty set and is linked with nothing. Documents are linked when
    100 * intersection >= ``percent`` * union; a component is named by its smallest id.

    The links are the large values of A * A^T, where A has a row per distinct set and a column per n-gram. Columns
    are counted over all rows; of a row only the prefix of its rarest columns takes part (``_prefixes``), and columns that
    nobody shares are left out. The product is done in blocks of rows: each multiplies some rows with all
    that are left, adds up the overlaps of every pair that the sizes allow, discards pairs whose overlap cannot
    reach the bound, compares the others on their full sets, and joins what is linked to components. A pair
    inside a component needs no product any more, and a column whose rows are one component is closed. The first
    block takes of every column the first of the rows for which it is the most common one (``_block_of_rows``), so a group of
    near copies costs one product for each of them; later blocks are ``GROWTH`` times larger. A block's rows are done after it.

    Sets, not pairs, are what moves: a pair is checked by streaming sets past a copy of the other one (``_similar``).
    NULL text is empty. Rows with one id, or without id, are one document: if their texts differ, all
    their sets link it. An empty table gives an empty result. Other columns are ignored.
    """
    source = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), whole().cast("binary").alias("text")
    )
    sized = written(source.mapInArrow(lambda x: _sizes(x, width), "doc long, n_shingles long, row binary"), "sizes")
    filled = sized.filter("n_shingles > 0")
    classes = written(filled.groupBy("row").agg(F.min("doc").alias("doc"), F.max("n_shingles").alias("n")), "classes")
    n_entries = classes.agg(F.sum("n")).first()[0] or 0
    # Of a class the document with the smallest id is read again.
    copies = written(filled.select("doc").distinct().join(classes.select("doc"), "doc", "left_anti"), "copies")
    entries = _entries(by_ids(source, copies, "doc", "left_anti"), n_entries, width, percent)
    read = written(classes.join(entries.select("row").distinct(), "row").select("doc").distinct(), "read")
    sets = by_ids(source, read, "doc").mapInArrow(lambda x: _sets(x, width), "row binary, shingles binary")
    sets = written(sets.dropDuplicates(["row"]), "sets")

    # The sets of one document are linked.
    several = filled.groupBy("doc").agg(F.min("row").alias("src"), F.max("row").alias("dst")).filter("src <> dst")
    several = written(several.select("doc", "src"), "several")
    same = filled.join(several, "doc").select("src", F.col("row").alias("dst"))
    parts = written(connected_components(same), "parts")
    rows_a_block = 1
    while True:
        placed = entries.join(parts.withColumnRenamed("node", "row"), "row", "left").select(
            *COLUMNS, F.coalesce("component", "row").alias("part")
        )
        spans = placed.groupBy("col").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y")
        placed = written(placed.join(written(spans.select("col"), "spans"), "col"), "open")
        if placed.isEmpty():
            break
        block = written(_block_of_rows(placed, rows_a_block), "block")
        pairs = written(_product(placed, block, percent), "pairs")
        links = _similar(pairs, sets, percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        known = parts.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        parts = written(connected_components(known.unionByName(links)), "parts")
        entries = placed.join(block, "row", "left_anti").select(*COLUMNS)
        rows_a_block *= GROWTH

    placed = written(
        classes.join(parts.withColumnRenamed("node", "row"), "row", "left").select(
            "row", "doc", F.coalesce("component", "row").alias("part")
        ),
        "placed",
    )
    firsts = written(placed.groupBy("part").agg(F.min("doc").alias("component")), "firsts")
    named = written(placed.join(firsts, "part").select("row", "component"), "named")
    return sized.join(named, "row", "left").select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("component", "doc"), F.lit(NO_ID)).alias("component_id"),
    )
