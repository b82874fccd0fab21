"""From raw documents to packed sequences: filter, deduplicate, mix, pack."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.llm.line_dedup import drop_repeated_lines  # noqa: E402
from newsloom.llm.mixing import mix  # noqa: E402
from newsloom.llm.near_dedup import drop_near_duplicates  # noqa: E402
from newsloom.llm.packing import pack  # noqa: E402
from newsloom.llm.quality import drop_low_quality  # noqa: E402
from newsloom.session import drop_scratch, recorded_scratch, written  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; all columns stay.

    NULL or empty text has too few words and goes. Documents without language, or of one with few words, are judged by the
    base rules alone. Repeated rows share their verdict. An empty table stays empty.
    """
    return drop_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; all documents and columns stay, and ``n_chars``, if there is one, is the length of what is left.

    NULL text is one empty line and stays NULL; a text whose lines all go is empty. Repeated rows are one document and
    keep the same lines. An empty table stays empty.
    """
    kept = drop_repeated_lines(docs).select("row.*")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; all columns stay.

    Documents without words are like no other and stay. Rows with one id, and rows without id, are one document: they
    stay or go together. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mixture, over the files written and within them.

    NULL text has no bytes; documents without source are one source. Repeated rows share a place. An empty
    table stays empty.
    """
    order = ["slot", F.xxhash64("row.doc_id", "row.text")]
    return mix(docs).repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, numbered in the order of the mixture. Packing
    sorts the documents anew, so their slots are computed again: the same documents have the same ones.

    NULL text is empty: a piece of its end alone. Repeated rows are packed each. An empty table gives no pieces.
    """
    slotted = mix(docs).select("row.doc_id", "row.text", "slot")
    return pack(slotted, slot="slot")


_scratch: dict[tuple[str, int], list[str]] = {}


def _stage(place: int, function: Callable) -> Callable:
    """``function`` as a stage. The tables that the stage before wrote for itself are dropped first, if its
    result has been written, so that this stage's ``docs`` does not read them any more; else later."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old = _scratch.pop((sf_dir, place - 1), [])
        files = docs.inputFiles() if old else []
        read = [path for path in old if any(f"/{os.path.basename(path)}/" in file for file in files)]
        if not read:
            drop_scratch(spark, old)
        with recorded_scratch() as made:
            result = function(spark, docs, sf_dir)
        _scratch[sf_dir, place] = made + (old if read else [])
        return result

    return stage


STAGES = [
    (name, _stage(place, function))
    for place, (name, function) in enumerate(
        [
            ("quality_rules", quality_rules),
            ("line_dedup", line_dedup),
            ("minhash_near_dedup", near_dedup),
            ("source_mixing", source_mixing),
            ("best_fit_packing", best_fit_packing),
        ]
    )
]

# Components and best fit are iterative: tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the table written by the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = written(docs, name)
    return docs
