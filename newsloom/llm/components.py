"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst of one orderable
    type); a component is named by its smallest node.

    Large and small stars in turn: every node links its larger neighbours, then its smaller
    ones, to the smallest node it knows, until all edges point at the smallest
    node of their component. A round is groupings and joins of edges, written to
    the shared folder; the driver sees a count and a checksum of it. Minima are
    pre-aggregated before each shuffle, and the joins have one row per node on one
    side, so Spark can split a node that holds most edges. Edges with NULL and loops
    are left out.
    """
    pairs = edges.select(
        F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    ).filter("src is not null and dst is not null and src <> dst")
    current = written(pairs.distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        current = written(_small_star(_large_star(current)), "edges")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(centres)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    return (
        both.join(lowest, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    lowest = pairs.groupBy("a").agg(F.min("b").alias("low"))
    smaller = pairs.join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return smaller.unionAll(lowest.select("a", F.col("low").alias("b"))).distinct()
