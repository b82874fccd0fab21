"""Exact deduplication by content hash, checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import lower_ascii, whole
from newsloom.session import written


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = lower_ascii,
    keep: Callable[[Column], Column] = F.min,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after ``normalise``; of equal texts
    the row with the id that ``keep`` chooses stays (``F.min``: the smallest).

    Only hashes are grouped. Rows whose hash occurs more than once are then
    compared with the text of the row chosen under that hash; rows that differ
    from it (a collision) are grouped by their bytes. A group's texts never meet
    in one task: both joins have one row per hash on one side, so Spark can
    split the other, and groups are counted with map-side partial sums.

    NULL text is empty text; empty texts are equal. A NULL id is chosen only when
    the group has no other. Rows that share id and text are one document: each
    gets a row, all with the same verdict. Other columns are ignored. An empty
    table gives an empty result.
    """
    texts = docs.select("doc_id", normalise(whole()).alias("body"))
    hashed = texts.withColumn("hash", hash_of(F.col("body")))
    narrow = written(
        hashed.select("doc_id", "hash", F.sha2("body", 256).alias("text_sha256")), "hashes"
    )
    groups = narrow.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), keep("doc_id").alias("first_id"))
    known = narrow.join(groups, "hash")

    singles = known.filter("n = 1").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )

    asked = known.filter("n > 1").select("doc_id", "hash", "first_id").distinct()
    repeated = written(
        hashed.alias("t")
        .join(
            asked.alias("a"),
            F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.hash") == F.col("a.hash")),
        )
        .select("t.doc_id", "t.hash", "body", F.col("t.doc_id").eqNullSafe(F.col("first_id")).alias("first")),
        "repeated",
    )
    first = repeated.filter("first").groupBy("hash").agg(F.min("body").alias("first_body"))
    # NULL for the bytes of the chosen row, else the row's own bytes.
    compared = repeated.join(first, "hash").select(
        "doc_id",
        "hash",
        F.when(F.col("body") != F.col("first_body"), F.col("body")).alias("other"),
        F.sha2("body", 256).alias("text_sha256"),
    )
    compared = written(compared, "compared")
    sizes = compared.groupBy("hash", "other").agg(
        F.count(F.lit(1)).alias("group_size"), keep("doc_id").alias("keep_id")
    )
    c, s = compared.alias("c"), sizes.alias("s")
    copies = c.join(
        s, (F.col("c.hash") == F.col("s.hash")) & F.col("c.other").eqNullSafe(F.col("s.other"))
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
    return singles.unionByName(copies)
