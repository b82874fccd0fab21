"""Where written intermediate tables go."""

import pyarrow as pa
import pytest

from newsloom import session


class Settings(dict):
    def __init__(self, master, **values):
        super().__init__(values)
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master})


def test_the_cluster_names_the_folder():
    named = Settings("yarn", **{"spark.checkpoint.dir": "hdfs://shared/work/"})
    assert session.scratch_dir(named, "x").startswith("hdfs://shared/work/x-")


def test_only_a_local_session_may_leave_it_out():
    assert session.scratch_dir(Settings("local[4]"), "x") != session.scratch_dir(Settings("local[4]"), "x")
    with pytest.raises(ValueError):
        session.scratch_dir(Settings("spark://host:7077"), "x")


def test_written_table_is_the_same_rows(spark):
    rows = spark.range(10).selectExpr("id", "cast(id as string) as text")
    assert session.written(rows, "t").exceptAll(rows).isEmpty()


def test_recorded_scratch_can_be_dropped(spark):
    with session.recorded_scratch() as outer:
        kept = session.written(spark.range(3).toDF("id"), "a")
        with session.recorded_scratch() as inner:
            session.written(spark.range(3).toDF("id"), "b")
    session.scratch_dir(spark, "c")
    assert len(outer) == 2 and outer[1:] == inner
    session.drop_scratch(spark, inner)
    import os

    assert kept.count() == 3 and os.path.exists(outer[0]) and not os.path.exists(inner[0])


def test_written_bounds_the_batches_of_python_tasks(spark):
    rows = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 100000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(session.BATCH_BYTES)
    counts = [r.n for r in session.written(rows.mapInArrow(sizes, "n long"), "sizes", 2**20).collect()]
    assert sum(counts) == 64 and max(counts) < 20
    assert spark.conf.get(session.BATCH_BYTES) == before
