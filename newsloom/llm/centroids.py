"""Centroid clustering of vectors in integers, with Shallot search for the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import drop_scratch, recorded_scratch, written

SIZE = 64  # components of a vector
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SLACK = 1e-9  # relative; distances between centroids and bounds are floating point, so they are held wide
PLAIN = 2**27  # components below this have squared distances of SIZE terms below 2**63
LIMB = 30  # bits
ROWS = 8192  # compared at a time

Vector = list[int]


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; Python integers where 64 bits are not enough for the distances."""
    if not len(values) or np.abs(values).max() * scale < PLAIN:
        return np.floor(values * scale).astype(np.int64)
    # From 2**53 on a double is an integer, and its product with the scale may pass its range.
    whole = [[int(x) * scale if abs(x) >= 2**53 else floor(x * scale) for x in row] for row in values.tolist()]
    return np.array(whole, object)


def _matrix(centroids: list[Vector], like: np.ndarray) -> np.ndarray:
    small = like.dtype != object and all(-PLAIN <= x <= PLAIN for c in centroids for x in c)
    return np.array(centroids, np.int64 if small else object)


def _squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one each."""
    return ((rows - centroid) ** 2).sum(axis=1)


def _root(squared: int) -> float:
    """The root, within SLACK; ``isqrt`` also takes what is beyond a double."""
    return float(squared) ** 0.5 if squared < 2**1000 else float(isqrt(squared))


def _roots(squared: np.ndarray) -> np.ndarray:
    if squared.dtype != object:
        return np.sqrt(squared.astype(np.float64))
    return np.array([_root(int(x)) for x in squared], np.float64)


class _Centroids:
    """The centroids of a round with, for each, all others by their distance from it."""

    def __init__(self, centroids: list[Vector], before: list[Vector] | None):
        self.centroids = centroids
        k = len(centroids)
        apart = [[_root(sum((x - y) ** 2 for x, y in zip(a, b))) for b in centroids] for a in centroids]
        self.apart = np.array(apart, np.float64).reshape(k, k)
        self.neighbours = np.argsort(self.apart, axis=1, kind="stable")
        moved = [_root(sum((x - y) ** 2 for x, y in zip(a, b))) for a, b in zip(centroids, before or centroids)]
        # How far the other centroids moved at most, for each.
        self.others_moved = np.array([max([m for j, m in enumerate(moved) if j != i], default=0.0) for i in range(k)])

    def nearest(self, rows: np.ndarray, near: np.ndarray, second: np.ndarray, lower: np.ndarray) -> tuple:
        """(near, second, lower, squared distance to near) of ``rows`` from those of the round before.

        ``lower`` is a bound of the distance to all but the nearest centroid. While the own centroid is
        closer than that, nothing else is looked at. Otherwise the scan starts from the closer one of the two remembered
        centroids, through its neighbours by distance, up to the distance at which none can be
        closer than the second best so far; that ball shrinks with every find. Distances are compared as integers,
        ties go to the smaller number.
        """
        near, second = near.copy(), second.copy()
        c = _matrix(self.centroids, rows)
        if c.dtype == object:
            rows = rows.astype(object)
        best = _squared(rows, c[near])
        lower = lower - self.others_moved[near] * (1 + SLACK)
        if len(c) == 1:
            return near, second, lower, best
        open_ = np.flatnonzero(_roots(best) * (1 + SLACK) >= lower)
        if not len(open_):
            return near, second, lower, best
        x = rows[open_]
        first, other = near[open_], second[open_]
        d1, d2 = best[open_], _squared(x, c[other])
        swap = (d2 < d1) | ((d2 == d1) & (other < first))
        first, other = np.where(swap, other, first), np.where(swap, first, other)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, remembered = first.copy(), other.copy()
        from_start = _roots(d1)
        for s in np.unique(start):
            mine = np.flatnonzero(start == s)
            for j in self.neighbours[s]:
                if j == s:
                    continue
                # Sorted by distance: what is out of the ball of this neighbour is out for all later ones.
                radius = (from_start[mine] + _roots(d2[mine])) * (1 + SLACK)
                mine = mine[self.apart[s, j] * (1 - SLACK) <= radius]
                if not len(mine):
                    break
                at = mine[remembered[mine] != j]
                d = _squared(x[at], c[j])
                wins = (d < d1[at]) | ((d == d1[at]) & (j < first[at]))
                follows = ~wins & (d < d2[at])
                w, f = at[wins], at[follows]
                d2[w], other[w] = d1[w], first[w]
                d1[w], first[w] = d[wins], j
                d2[f], other[f] = d[follows], j
        near[open_], second[open_], best[open_] = first, other, d1
        lower[open_] = _roots(d2) * (1 - SLACK)
        return near, second, lower, best


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """An integer as digits below 2**30 of its powers, so that sums of any size add up in 64 bits."""
    sign, value, power = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield power, sign * (value & (2**LIMB - 1))
        value >>= LIMB
        power += 1


def _vectors(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


SUMS = "sums array<struct<cluster:int,place:int,power:int,digit:bigint>>"
SUMS_ARROW = pa.list_(
    pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("power", pa.int32()), ("digit", pa.int64())])
)
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
STATE = "vec_id long, embedding array<double>, near int, second int, lower double"


def _assigned(
    batches: Iterator[pa.RecordBatch], centroids: list[Vector], before: list[Vector] | None, size: int, scale: int, last: bool
) -> Iterator[pa.RecordBatch]:
    """Each vector with its centroids; at the end of a task one more row with its sums by cluster, or in the
    ``last`` assignment the distances instead."""
    found = _Centroids(centroids, before)
    sums = [[0] * (size + 1) for _ in centroids]  # the last place: how many
    schema = None
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            rows = _integers(_vectors(batch.column(1), size), scale)
            state = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            near, second, lower, best = found.nearest(rows, *state)
            if last:
                exact = pa.array([int(d) if d < 2**63 else None for d in best] if best.dtype == object else best, pa.int64())
                yield pa.record_batch(
                    [batch.column(0), pa.array(near, pa.int32()), exact], names=["vec_id", "cluster", "distance"]
                )
                continue
            for cluster in np.unique(near):
                own = rows[near == cluster]
                for place, value in enumerate([*own.sum(axis=0).tolist(), len(own)]):
                    sums[cluster][place] += value
            columns = [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(lower)]
            names = ["vec_id", "embedding", "near", "second", "lower"]
            schema = pa.schema([*(pa.field(n, c.type) for n, c in zip(names, columns)), pa.field("sums", SUMS_ARROW)])
            yield pa.record_batch([*columns, pa.nulls(len(near), SUMS_ARROW)], schema=schema)
    if schema is not None:
        rows = [
            {"cluster": cluster, "place": place, "power": power, "digit": digit}
            for cluster, own in enumerate(sums)
            for place, value in enumerate(own)
            for power, digit in _limbs(value)
        ]
        yield pa.record_batch([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), pa.array([rows], SUMS_ARROW)], schema=schema)


def _moved(state: DataFrame, centroids: list[Vector], size: int) -> list[Vector]:
    """The componentwise floor of the means; a centroid without vectors stays. The driver gets one number per
    component and power."""
    parts = (
        state.filter("sums is not null").select(F.inline("sums")).groupBy("cluster", "place", "power").agg(F.sum("digit").alias("n"))
    )
    sums = [[0] * (size + 1) for _ in centroids]
    for row in parts.collect():
        sums[row.cluster][row.place] += row.n << (LIMB * row.power)
    return [[x // own[-1] for x in own[:-1]] if own[-1] else old for own, old in zip(sums, centroids)]


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
    seed: str = "1",
) -> DataFrame:
    """One row per kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Kept are vectors of exactly ``size`` components, none NULL or not finite; a component x becomes the integer
    floor(``scale`` * x). The centroids start as the vectors whose lower-case hex sha256 of ``seed``:vec_id is
    smallest. Each round assigns every vector to its nearest centroid (squared distance, ties: the smaller number) and moves
    every centroid to the componentwise floor of its vectors' mean; then vectors are assigned once more.

    The search is Shallot's: a vector remembers its nearest and second nearest centroid and a bound of the distance to
    all others, and most are settled by that bound (``_Centroids.nearest``). Vectors stay where they are: a
    round reads one table of vectors and bounds and writes the next one, with sums by cluster as one row per
    task. The table before is dropped then. The driver and the tasks hold ``clusters`` * ``size`` integers.

    A NULL id counts as empty text in the hash; repeated rows each count, and of rows with one hash the smaller
    vector comes first. Fewer vectors than ``clusters`` are as many centroids. All arithmetic is exact; a
    distance or sum that a long cannot hold is NULL. No vectors give an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    values = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).filter(
        (F.size("embedding") == size)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    firsts = kept.orderBy(by_hash, "embedding").limit(clusters).collect()
    centroids = [[int(x) for x in _integers(np.array([r.embedding]), scale)[0]] for r in firsts]
    if not centroids:
        return spark.createDataFrame([], RESULT)
    other = min(1, len(centroids) - 1)
    state = kept.withColumns({"near": F.lit(0), "second": F.lit(other), "lower": F.lit(0.0)})
    before, old = None, []
    for _ in range(rounds):
        with recorded_scratch() as made:
            found = state.mapInArrow(
                lambda x, c=centroids, b=before: _assigned(x, c, b, size, scale, False), f"{STATE}, {SUMS}"
            )
            found = written(found, "vectors")
        drop_scratch(spark, old)
        before, centroids, old = centroids, _moved(found, centroids, size), made
        state = found.filter("sums is null").drop("sums")
    with recorded_scratch() as made:
        last = state.mapInArrow(
            lambda x, c=centroids, b=before: _assigned(x, c, b, size, scale, True), "vec_id long, cluster int, distance long"
        )
        last = written(last, "clusters")
    drop_scratch(spark, old)
    # One row per cluster: ``clusters`` rows at most.
    wide = F.col("distance").cast("decimal(38,0)")
    complete = F.count("distance") == F.count(F.lit(1))
    sums = last.groupBy("cluster").agg(F.when(complete, F.sum(wide)).alias("own")).collect()
    total = None if any(r.own is None for r in sums) else sum(int(r.own) for r in sums)

    def fits(x) -> int | None:
        return None if x is None or x >= 2**63 else int(x)

    own = spark.createDataFrame(
        [
            (r.cluster, fits(r.own), fits(total), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest())
            for r in sums
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return last.join(F.broadcast(own), "cluster").select(*[f.split()[0] for f in RESULT.split(", ")])
