"""Session settings, and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("newsloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    builder = builder.config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="newsloom-"))
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="newsloom-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A cluster must set it to a folder that all executors share. A session on
    one machine may come without it (it cannot be set later) and gets a folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        root = _own_root()
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _recording:
        made.append(path)
    return path


_recording: list[list[str]] = []


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The scratch folders named within the block, so that they can be dropped when
    nothing reads them any more."""
    made: list[str] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording[:] = [other for other in _recording if other is not made]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders, on whatever file system they are."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, and still
    there when executors are lost. Python tasks get batches of about ``batch_bytes``, if given."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with _batches(spark, batch_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    if most is None:
        yield
        return
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)
