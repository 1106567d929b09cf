"""Exact integer centroid clustering that skips centroids by Ptolemy's inequality.

For any vector q, centroid c and pivots s, t: d(q, c) >= |d(q, s) d(c, t) - d(q, t) d(c, s)| / d(s, t).
The pivots are the starting centroids and stay fixed, so a vector's distances to them are computed
once and kept with it. A round computes the centroids' distances to the pivots, bounds every pair of
vector and centroid from below, and computes only distances whose bound does not exceed the best so far.
Bounds are rounded down, distances are whole numbers, so the result is that of computing all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.vectors import usable
from adtally.session import materialize

#: Whole components stay below this, so that no squared distance leaves 64 bits.
COMPONENT_LIMIT = 1 << 26
#: Far above the error of a handful of roundings in double precision.
_SLACK = 1e-14

KEPT_SCHEMA = "vec_id long, x array<int>, to_pivots array<double>"
RESULT_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed int"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= COMPONENT_LIMIT:
        raise ValueError(f"a component reaches {COMPONENT_LIMIT}: squared distances might not fit 64 bits")
    return scaled.astype(np.int64)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Pivots:
    """Fixed points, and for each centroid the pairs of them its bounds are taken from."""

    points: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squared(x, p) for p in self.points], axis=1).astype(np.float64))

    def lower_bounds(self, to_pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Never above the true distances, whatever the rounding.

        A centroid's pairs are its nearest pivot with every other one: the nearer a pivot, the
        sharper its pairs. Pairs of equal pivots tell nothing and are left out.
        """
        of_centroids, between = self.distances(centroids), self.distances(self.points)
        bounds = np.zeros((len(to_pivots), len(centroids)))
        for c, away in enumerate(of_centroids):
            s = int(away.argmin())
            others = np.flatnonzero(between[s] > 0)
            one, two = to_pivots[:, [s]] * away[others], to_pivots[:, others] * away[s]
            sure = (np.abs(one - two) - _SLACK * (one + two)) / between[s, others]
            bounds[:, c] = sure.max(axis=1, initial=0.0) * (1 - _SLACK)
        return bounds


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector the nearest centroid (ties: the smaller number), its squared distance, and how many were computed."""
    bounds = pivots.lower_bounds(to_pivots, centroids)
    cluster = bounds.argmin(axis=1)
    least = squared(x, centroids[cluster])
    first, computed = cluster.copy(), np.ones(len(x), np.int32)
    floor = bounds * bounds * (1 - _SLACK)
    for c, centre in enumerate(centroids):
        rows = np.flatnonzero((floor[:, c] <= least) & (first != c))
        away = squared(x[rows], centre)
        better = (away < least[rows]) | ((away == least[rows]) & (c < cluster[rows]))
        cluster[rows[better]], least[rows[better]] = c, away[better]
        computed[rows] += 1
    return cluster, least, computed


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=dtype).reshape(-1, width)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1,
             id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed``, one row per kept vector.

    Kept are vectors of ``width`` components, none null or non-finite, turned into
    ``floor(scale * x)``. Centroids start as the ``k`` kept vectors of smallest sha256 of
    ``<seed>:<id>`` (all, if fewer; a null id comes last, equal ids go by their components); each round
    assigns every vector and moves non-empty centroids to the floored mean. ``computed`` is the
    number of distances the last assignment computed for the vector.

    Repeated rows are rows like any other. No kept vector gives no rows. Other columns are
    left out. A whole component of 2^26 or more is an error. Only centroids and one sum per
    centroid and component, ``k * width`` numbers, come to the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    kept = rows.where(usable("vector", zero_too=True) & (F.size("vector") == width))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(mark.asc_nulls_last(), "vector").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    centroids = whole(np.array([row["vector"] for row in starts]), scale)
    pivots = Pivots(centroids)

    def with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(_matrix(batch.column("vector"), width, np.float64), scale)
            away = pivots.distances(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(x.astype(np.int32)), _lists(away)], names=["vec_id", "x", "to_pivots"]
            )

    kept = materialize(kept.mapInArrow(with_pivots, KEPT_SCHEMA), "pivot-distances")
    for _ in range(rounds):
        centroids = _moved(kept, centroids, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width, np.int64)
            cluster, least, computed = nearest(x, _matrix(batch.column("to_pivots"), len(pivots.points), np.float64), centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(least), pa.array(computed)],
                names=["vec_id", "cluster", "distance", "computed"],
            )

    assigned = materialize(kept.mapInArrow(assign, "vec_id long, cluster int, distance long, computed int"), "assigned")
    # One row per centroid.
    inertia = {row["cluster"]: row["inertia"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of_cluster = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), digest) for c, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(of_cluster), "cluster").select(*(f.split()[0] for f in RESULT_SCHEMA.split(", ")))


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), table.ravel())


def _moved(kept: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The floored means of what is nearest to each centroid; one that has nothing stays."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), width, np.int64)
            cluster, _, _ = nearest(x, _matrix(batch.column("to_pivots"), len(pivots.points), np.float64), centroids, pivots)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(total[some])], names=["cluster", "n", "total"]
        )

    parts = kept.mapInArrow(sums, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    moved = centroids.copy()
    for row in each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect():
        moved[row["cluster"], row["place"]] = row["total"] // row["n"]
    return moved
