"""Markers of what is under way in a store: one small file per ingest that has not ended, and per table that is
being rewritten. They say what a run that broke off has left behind.

Files are reached through Hadoop's file systems, so a store can be wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_journal"
BEGUN, REWRITE = ".begun", ".rewrite"


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _at(spark, path)
    return files.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _at(spark, path)
    files.delete(folder, True)


def _write(spark: SparkSession, path: str, text: str) -> None:
    target, files = _at(spark, path)
    out = files.create(target, True)
    out.write(text.encode())
    out.close()


def _names(spark: SparkSession, path: str, kind: str) -> list[str]:
    folder, files = _at(spark, f"{path}/{FOLDER}")
    if not files.exists(folder):
        return []
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return sorted(name.removesuffix(kind) for name in names if name.endswith(kind))


def begin(spark: SparkSession, path: str) -> str:
    """The name of a new run, marked as begun: until :func:`finish`, readers leave out its keys and counts."""
    run = uuid.uuid4().hex
    _write(spark, f"{path}/{FOLDER}/{run}{BEGUN}", "")
    return run


def finish(spark: SparkSession, path: str, run: str) -> None:
    remove(spark, f"{path}/{FOLDER}/{run}{BEGUN}")


def pending(spark: SparkSession, path: str) -> list[str]:
    """Runs that have begun and not ended."""
    return _names(spark, path, BEGUN)


def begin_rewrite(spark: SparkSession, path: str, table: str, copy: str) -> str:
    """Note that ``table`` is about to be overwritten with the rows of ``copy``."""
    name = uuid.uuid4().hex
    _write(spark, f"{path}/{FOLDER}/{name}{REWRITE}", json.dumps({"table": table, "copy": copy}))
    return name


def finish_rewrite(spark: SparkSession, path: str, name: str) -> None:
    remove(spark, f"{path}/{FOLDER}/{name}{REWRITE}")


def rewrites(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(name, table, copy) of rewrites that have not ended."""
    found = []
    for name in _names(spark, path, REWRITE):
        text = spark.read.text(f"{path}/{FOLDER}/{name}{REWRITE}", wholetext=True).first().value
        noted = json.loads(text)
        found.append((name, noted["table"], noted["copy"]))
    return found
