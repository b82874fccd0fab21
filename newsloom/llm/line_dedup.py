"""Lines repeated across documents, found by a range sort of their hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.llm.columns import whole
from newsloom.session import written

MIN_CHARS = 40
MIN_DOCS = 5
NO_ID = -(2**63)  # stands for a NULL id, the smallest of all

LINES = "high long, low long, doc long, text_key long, n_lines int, at int"
FOUND = "high long, low long, doc long, text_key long, n_lines int, at int, decided boolean, new_doc boolean"
BITMAP = "doc long, text_key long, n_lines int, n_dropped int, keep_bitmap binary"


def line_key(line: bytes) -> bytes:
    """Without ASCII white space at both ends, A-Z in lower case."""
    return line.strip().lower()


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, docs, keys, counts, places = [], [], [], [], []
        for doc, key, text in zip(*(column.to_pylist() for column in batch.columns)):
            lines = text.split(b"\n")
            for at, line in enumerate(lines):
                if len(line) < min_chars:
                    continue
                line = line_key(line)
                if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                    digests.append(xxhash.xxh3_128_digest(line))
                    docs.append(doc)
                    keys.append(key)
                    counts.append(len(lines))
                    places.append(at)
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = (halves[:, 0], halves[:, 1], docs, keys)
        yield pa.record_batch(
            [pa.array(np.array(c, np.int64)) for c in columns]
            + [pa.array(np.array(c, np.int32)) for c in (counts, places)],
            names=["high", "low", "doc", "text_key", "n_lines", "at"],
        )


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: the lines that go, and all lines of its first and last
    hash, which other partitions may share, as undecided."""

    def judged(table: pa.Table, open_start: bool, open_end: bool) -> pa.Table:
        high, low, doc = (table.column(i).to_numpy() for i in range(3))
        group = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        new_doc = group | np.r_[True, doc[1:] != doc[:-1]]
        starts = np.flatnonzero(group)
        of = np.cumsum(group) - 1
        n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        decided = np.ones(len(doc), bool)
        if open_start:
            decided[of == 0] = False
        if open_end:
            decided[of == of[-1]] = False
        drop = decided & (n_docs[of] >= min_docs) & (doc != doc[starts][of])
        table = table.append_column("decided", pa.array(decided)).append_column("new_doc", pa.array(new_doc))
        return table.filter(pa.array(drop | ~decided))

    waiting: list[pa.RecordBatch] = []  # the last hash so far
    first = True
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*waiting, batch])
        high, low = table.column(0).to_numpy(), table.column(1).to_numpy()
        differs = np.flatnonzero((high != high[-1]) | (low != low[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield from judged(table.slice(0, cut), first, False).to_batches()
            first = False
        waiting = table.slice(cut).to_batches()
    if waiting:
        yield from judged(pa.Table.from_batches(waiting), first, True).to_batches()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by document and place, to one bitmap per document."""

    def packed(table: pa.Table) -> list[tuple]:
        doc, key, n_lines, at = (table.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        rows = []
        for start, end in zip(starts, [*starts[1:], len(doc)]):
            keep = np.ones(int(n_lines[start]), bool)
            keep[at[start:end]] = False
            bits = zlib.compress(np.packbits(keep).tobytes())
            rows.append((int(doc[start]), int(key[start]), len(keep), int((~keep).sum()), bits))
        return rows

    schema = pa.schema(
        [("doc", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int32()), ("keep_bitmap", pa.binary())]
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([*waiting, batch])
        doc, key = table.column(0).to_numpy(), table.column(1).to_numpy()
        differs = np.flatnonzero((doc != doc[-1]) | (key != key[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield batch_of(packed(table.slice(0, cut)))
        waiting = table.slice(cut).to_batches()
    if waiting:
        yield batch_of(packed(pa.Table.from_batches(waiting)))


def _keys() -> list:
    """What tells rows apart: id and text, so that repeated rows share a bitmap."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.xxhash64(whole()).alias("text_key")]


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_key, n_lines, n_dropped, keep_bitmap) of documents that lose lines.

    A line's key is the line without ASCII white space at both ends, A-Z in lower
    case. Keys of ``min_chars`` code points or more that are found in ``min_docs`` documents
    or more keep their lines in the document with the largest id only.

    128-bit hashes of the keys, with document and place, are range-partitioned
    and sorted by (hash, document, place), so a hash that fills many partitions is
    split between them. Each partition is streamed once: the first document of a
    hash keeps, the rest go when there are enough. Only the first and the last
    hash of a partition may continue elsewhere; for these, one row per hash is
    summed up over all partitions, at most two rows per partition.

    The bitmap has a bit per line, 1 for kept, packed and deflated. Documents
    with one id count as one document.
    """
    source = docs.select(*_keys(), whole().cast("binary").alias("text"))
    hashed = written(source.mapInArrow(lambda batches: _hash_lines(batches, min_chars), LINES), "lines")
    order = [F.col("high"), F.col("low"), F.col("doc").desc()]
    found = written(
        hashed.repartitionByRange(*order)
        .sortWithinPartitions(*order, "at")
        .mapInArrow(lambda batches: _stream(batches, min_docs), FOUND),
        "found",
    )
    columns = ["doc", "text_key", "n_lines", "at"]
    # All rows of one hash and document are in one partition, so the sum counts documents.
    open_ends = found.filter("not decided")
    totals = open_ends.groupBy("high", "low").agg(
        F.max("doc").alias("keeper"), F.sum(F.col("new_doc").cast("long")).alias("n_docs")
    )
    late = (
        open_ends.join(F.broadcast(totals), ["high", "low"])
        .filter((F.col("n_docs") >= min_docs) & (F.col("doc") != F.col("keeper")))
        .select(*columns)
    )
    dropped = found.filter("decided").select(*columns).unionByName(late)
    return dropped.repartition("doc", "text_key").sortWithinPartitions("doc", "text_key").mapInArrow(_bitmaps, BITMAP)


@F.arrow_udf(StringType())
def kept_lines(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    """The lines of a text whose bit is set; the text itself without bitmap."""
    out = []
    for body, packed in zip(text.to_pylist(), bitmap.to_pylist()):
        if packed is not None:
            lines = body.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines))
            body = "\n".join(line for line, bit in zip(lines, keep) if bit)
        out.append(body)
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the kept lines as ``text``: (row: its columns, n_lines, n_dropped).

    ``row`` is a struct of the given columns, so their names clash with nothing.
    NULL or empty text is one empty line and stays as it is. Rows that share id and
    text are judged alike. An empty table gives an empty result.
    """
    bitmaps = written(line_bitmaps(docs, min_chars, min_docs), "bitmaps").drop("n_lines")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys())
    joined = keyed.join(bitmaps, ["doc", "text_key"], "left")
    text = F.when(F.col("keep_bitmap").isNull(), F.col("row.text")).otherwise(F.col("kept"))
    return joined.withColumn("kept", kept_lines(F.col("row.text"), F.col("keep_bitmap"))).select(
        F.col("row").withField("text", text).alias("row"),
        F.size(F.split(whole("row.text"), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
