"""Running numbers over any number of rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import written


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their number from 1 in ``order``.

    Every task numbers its range of the sorted rows; the driver adds up one count
    per partition. The sorted rows are written to the shared folder once.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the place in it below.
    placed = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit(2**33 - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((r.n for r in sizes), initial=0)
    offsets = spark.createDataFrame([(r.part, n) for r, n in zip(sizes, before)], "_part long, _before long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_before", "_row")
    )
