"""Pruned integer clustering against computing all distances."""

import hashlib

import numpy as np
import pytest

from adtally.llm.ptolemy import Pivots, clusters, nearest, squared
from adtally.llm.registered import QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string, distance long, c int"


def brute(rows, k=16, rounds=3, width=64):
    """The contract, row by row in whole numbers."""
    kept = [(n, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for n, v in rows
            if v is not None and len(v) == width and None not in v and np.isfinite(np.array(v, float)).all()]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centres = [list(map(int, v)) for _, v in order[:k]]
    x = np.array([v for _, v in kept])

    def assign():
        d = np.stack([((x - np.array(c)) ** 2).sum(1) for c in centres], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _ = assign()
        centres = [[int(s) // int((at == c).sum()) for s in x[at == c].sum(0)] if (at == c).any() else centre
                   for c, centre in enumerate(centres)]
    at, d = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((n, int(c), int(e), int(d[at == c].sum()), int(d.sum()), digest[c]) for (n, _), c, e in zip(kept, at, d))


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_all_distances(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 64))
    x = (centres[rng.integers(0, 9, 400)] + spread * rng.normal(size=(400, 64))).astype(np.float32)
    x[100:230] = x[100]  # a third of all rows share a vector
    rows = [(n, x[n].tolist()) for n in range(400)]
    odd = [(900, None), (901, [float("nan")] * 64), (902, [None] + [1.0] * 63), (903, [float("-inf")] + [0.0] * 63), (904, [1.0] * 63), (905, [])]
    all_rows = rows + [rows[7]] * 3 + odd
    frame = spark.createDataFrame([(n, v, 0, "x", 1, 2) for n, v in all_rows], SCHEMA).repartition(7)
    assert rows_of(clusters(frame)) == brute(all_rows)


def test_equal_centroids_and_few_vectors(spark):
    """Ties go to the smaller number, and a centroid that has nothing stays."""
    rows = [(n, [float(n // 4)] * 64) for n in range(12)]
    frame = spark.createDataFrame([(n, v, 0, "x", 1, 2) for n, v in rows], SCHEMA)
    assert rows_of(clusters(frame)) == brute(rows)
    assert clusters(frame.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, [1.0] * 64, 0, "x", 1, 2), (5, [1.0] * 64, 0, "x", 1, 2)], SCHEMA)
    assert [(r.vec_id, r.cluster) for r in clusters(nameless).orderBy("vec_id").collect()] == [(None, 0), (5, 0)]


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(8)
    middles = rng.integers(-900, 900, (20, 64))
    x = middles[rng.integers(0, 20, 3_000)] + rng.integers(-20, 20, (3_000, 64))
    pivots = Pivots(x[:16])
    centres = middles[:16] + rng.integers(-15, 15, (16, 64))
    away = pivots.distances(x)
    bounds = pivots.lower_bounds(away, centres)
    true = np.stack([squared(x, c) for c in centres], 1)
    assert (np.floor(bounds**2) <= true).all() and (bounds > 0).mean() > 0.5
    cluster, least, computed = nearest(x, away, centres, pivots)
    assert (cluster == true.argmin(1)).all() and (least == true.min(1)).all()
    assert computed.mean() < 8  # of 16


def test_bounds_are_rounded_down():
    """Vectors in line with the pivots, where the bound is the distance itself, at large components."""
    line = np.arange(64)[None] * np.array([[0], [1], [500_000], [700_001]])
    pivots = Pivots(line[:2])
    bounds = pivots.lower_bounds(pivots.distances(line), line)
    true = np.stack([squared(line, c) for c in line], 1)
    assert (bounds**2 * (1 - 1e-14) <= true).all()
    assert (nearest(line, pivots.distances(line), line, pivots)[0] == np.arange(4)).all()


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(n, [3e9] * 64, 0, "x", 1, 2) for n in range(2)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        clusters(frame).count()


def test_registered_query(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    assert rows_of(QUERIES["op11_ptolemaic_clusters"](spark, small)) == brute([(r.vec_id, r.embedding) for r in table])
