"""Vector searches against all inner products."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adtally.llm.metric_tree import _NONE, Page, TreeBuilder, search_block, tree_search
from adtally.llm.multi_index import drawn, search, traverse
from adtally.llm.registered import QUERIES, table

SCHEMA = "vec_id long, embedding array<float>, score int, ids int, rank int"


def brute(rows, k, step, integer):
    names = np.array([n for n, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x = np.floor(x * 1024) if integer else x
    out = {}
    for i in np.flatnonzero(names % step == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((names, -s)) if names[j] != names[i]][:k]
        out[int(names[i])] = [(int(names[j]), float(s[j])) for j in order]
    return out


def lists(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, float(r.score)))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6)).astype(np.float32) * rng.uniform(0.2, 3, size=(900, 1)).astype(np.float32)
    x[300:600] = x[300]  # a third of all rows share a vector
    rows = [(n, x[n].tolist()) for n in range(900)]
    odd = [(2000, None), (2001, [float("nan")] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0]), (None, [1.0] * 6)]
    extra = rows + [rows[20]] * 2  # repeated rows
    return spark.createDataFrame([(n, v, 0, 0, 0) for n, v in extra + odd], SCHEMA).repartition(5), rows


def test_exact_search_is_exact(vectors):
    frame, rows = vectors
    got = lists(tree_search(frame, frame.where("vec_id % 100 = 0"), k=10, rows_per_tree=64, page=8, block=4))
    assert got == brute(rows, 10, 100, True)


def test_bounds_save_distance_computations():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 4)) * 3_000
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(1_000, 4)) * 30).astype(np.int64)
    radius2 = int((x * x).sum(axis=1).max())
    tree = TreeBuilder(x, [[i] for i in range(1_000)], radius2, 16)
    tree.add(np.arange(1_000), x[0], float(tree.height[0]))
    assert all(isinstance(p, Page) and len(p.vectors) <= 16 for p in tree.pages)
    q = x[int((x * x).sum(axis=1).argmax())]
    away = float(np.sqrt(max(q @ q + radius2 - 2 * (q @ x[0]), 0)))
    found, computed = search_block(tree.pages, q[None], np.array([-1]), np.array([away]), radius2, 5, np.array([_NONE]))
    s = x @ q
    assert found.scores[0].tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert computed[0] < 600


@pytest.mark.parametrize("scale", [30, 3_000_000, 30_000_000])
def test_a_block_of_queries_finds_what_each_would(scale):
    """Ties, ids in several entries, floors, and sums too large for doubles."""
    rng = np.random.default_rng(9)
    x = rng.integers(-scale, scale, (700, 8))
    x[200:260] = x[200] * np.array([1] * 7 + [-1])
    radius2 = int((x * x).sum(axis=1).max())
    ids = [[3 * i, 3 * i + 1] if i % 5 == 0 else [3 * i] for i in range(700)]
    tree = TreeBuilder(x, ids, radius2, 16)
    tree.add(np.arange(700), x[0], float(tree.height[0]))
    q, own = x[::23], np.arange(0, 700, 23) * 3
    away = np.sqrt(np.maximum((q * q).sum(axis=1) + radius2 - 2.0 * (q @ x[0]), 0))
    floors = np.where(np.arange(len(q)) % 3 == 0, _NONE, np.sort(q @ x.T, axis=1)[:, -4])
    tops, _ = search_block(tree.pages, q, own, away, radius2, 6, floors)
    for i, query in enumerate(q):
        every = [(-int(query @ x[r]), name) for r in range(700) for name in ids[r] if name != own[i] and query @ x[r] >= floors[i]]
        want = sorted(every)[:6]
        kept = tops.scores[i] != _NONE
        assert list(zip((-tops.scores[i][kept]).tolist(), tops.ids[i][kept].tolist())) == want


def test_all_cells_give_the_exact_answer(vectors):
    frame, rows = vectors
    got = lists(search(frame, frame.where("vec_id % 20 = 0"), k=7, codewords=8, share=1.0, groups=3, chunk=100, block=16))
    want = brute(rows, 7, 20, False)
    assert {q: [n for n, _ in r] for q, r in got.items()} == {q: [n for n, _ in r] for q, r in want.items()}
    for q, r in got.items():
        np.testing.assert_allclose([s for _, s in r], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def test_cells_come_in_order_of_summed_nearness():
    rng = np.random.default_rng(4)
    a, b, counts = rng.normal(size=7), rng.normal(size=9), rng.integers(0, 4, 63)
    cells = traverse(a, b, counts, 40)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert sums == sorted(sums, reverse=True) and counts[cells].sum() >= 40 > counts[cells[:-1]].sum()
    assert len(traverse(a, b, counts, 10**9)) == (counts > 0).sum()


def test_recall_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    want, got = brute(rows, 20, 20, False), lists(QUERIES["op1_multi_index"](spark, folder))
    hits = sum(len({n for n, _ in want[q]} & {n for n, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits / (20 * len(want)) >= 0.9


def test_recall_comes_from_a_part_of_the_entries(spark):
    """On clustered vectors a tenth of the entries holds the neighbours; on the given, nearly random ones it takes half."""
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + rng.normal(size=(2_000, 16)) * 0.3).astype(np.float32)
    rows = [(n, v.tolist()) for n, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = search(frame, frame.where("vec_id % 20 = 0"), k=20, share=0.1).cache()
    want, got = brute(rows, 20, 20, False), lists(found)
    hits = sum(len({n for n, _ in want[q]} & {n for n, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits / (20 * len(want)) >= 0.9
    assert found.agg({"looked_at": "max"}).first()[0] < 500
    given = QUERIES["op1_multi_index"](spark, "/root/testdata/sf0.1")
    assert given.agg({"looked_at": "max"}).first()[0] < 0.55 * 2_000


def test_a_crowded_cell_is_scored_in_many_parts(vectors):
    """One cell holds two thirds of the entries; its parts give what the whole gives."""
    frame, _ = vectors
    one, many = (
        lists(search(frame, frame.where("vec_id % 20 = 0"), k=7, codewords=2, share=0.7, groups=2, chunk=chunk))
        for chunk in (10_000, 10)
    )
    assert {q: [n for n, _ in r] for q, r in one.items()} == {q: [n for n, _ in r] for q, r in many.items()}


def test_the_driver_holds_a_sample_of_wide_vectors_once(spark):
    """4 MB of numbers; as Python's floats and doubles of all of them they took ten times that."""
    x = np.random.default_rng(13).normal(size=(1_000, 1_024)).astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(1_000), "embedding": pa.array(list(x))})).repartition(4)
    asked = frame.where("vec_id % 500 = 0")
    search(frame, asked, codewords=4).count()  # modules loaded late
    tracemalloc.start()
    try:
        found = search(frame, asked, codewords=4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * x.nbytes
    assert set(lists(found)) == {0, 500}


def test_a_sample_in_pieces_is_the_one_of_least_hash(spark):
    x = np.random.default_rng(14).normal(size=(500, 6)).astype(np.float32)
    frame = spark.createDataFrame([(n * 7, v.tolist()) for n, v in enumerate(x)], "vec_id long, vector array<float>").repartition(5)
    order = [r.vec_id // 7 for r in frame.orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    for sample in (1, 200, 500, 900):
        for piece in (4_000, 1 << 23):
            np.testing.assert_array_equal(drawn(frame, sample, 6, piece), x[order[:sample]])


@pytest.mark.parametrize("find", [search, tree_search])
def test_few_or_no_vectors(spark, find):
    nothing = spark.createDataFrame([], SCHEMA)
    assert find(nothing, nothing).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, 0), (1, [1.0, 2.0], 0, 0, 0)], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in find(two, two.where("vec_id = 0")).collect()] == [(0, 1)]
