"""The mix: targets, quotas that add up, draws of the right distribution, repeatable."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adtally.llm.mixing import hypergeometric, mixed, shard_quotas, shuffled_shards
from adtally.llm.registered import QUERIES

SCHEMA = "doc_id long, text string, source string, size int, block int, place int"


def targets(sizes):
    """Water filling by hand."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 3 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(n, "w " * int(rng.integers(1, 60)), f"s{min(9, int(rng.geometric(0.3)))}", 0, 0, 0) for n in range(3_000)]
    rows += [(10_000, None, "s1", 0, 0, 0), (10_001, "", None, 0, 0, 0), (10_002, "tiny", "few", 0, 0, 0), (None, "a b c", None, 0, 0, 0)]
    rows += [(20_000, "big " * 8_000, "s2", 0, 0, 0)] + [(5, "again and again", "s1", 0, 0, 0)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def test_targets_and_what_is_taken(docs):
    frame, rows = docs
    got = mixed(frame, block_words=2_000).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r._size == len((r.text or "").split()) and r._source_size == sizes[r.source]
        assert r._target == pytest.approx(want[r.source]) and len(r._shards) <= 3 and all(0 <= s < 64 for s in r._shards)
        taken[r.source] += r._size * len(r._shards)
    for source, size in sizes.items():
        # Documents are taken whole: a source with one of 8,000 words cannot be met closer.
        assert taken[source] == pytest.approx(want[source], rel=0.03, abs=8_000 if source == "s2" else 5), source


def test_reruns_and_shards_agree(docs):
    frame, _ = docs
    first = mixed(frame, block_words=2_000, keep=False)
    decided = {(r.doc_id, tuple(r._shards)) for r in first.collect()}
    assert decided == {(r.doc_id, tuple(r._shards)) for r in mixed(frame.repartition(7), block_words=2_000, keep=False).collect()}
    out = shuffled_shards(mixed(frame, block_words=2_000), frame.columns)
    assert out.columns == frame.columns
    copies = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in first.collect():
        want[r.doc_id] += len(r._shards)
    assert copies == Counter({k: v for k, v in want.items() if v})


def test_quotas_add_up_at_every_node(spark):
    counts = [1000, 7, 0, 250, 1]
    leaves = shard_quotas(spark.createDataFrame([(counts,)], "counts array<long>"), 4, 9).collect()
    assert len(leaves) == 16
    assert [sum(r.counts[i] for r in leaves) for i in range(5)] == counts
    sizes = [sum(r.counts) for r in leaves]
    assert max(sizes) - min(sizes) <= 1


def test_draws_have_the_hypergeometric_distribution(spark):
    n, k, m = 40, 13, 20
    rows = spark.range(20_000).select(
        hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), (F.col("id") + 0.5) / 20_000).alias("x")
    )
    got = Counter(r.x for r in rows.collect())
    for x in range(0, 14):
        want = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
        assert got.get(x, 0) / 20_000 == pytest.approx(want, abs=2e-4)


def test_nothing_to_mix(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = spark.createDataFrame([(1, "", "a", 0, 0, 0), (2, None, None, 0, 0, 0)], SCHEMA)
    assert {r._size for r in mixed(empty).collect()} == {0}


def test_no_python_in_the_plan(spark, small):
    plan = QUERIES["op3_mixing"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_of_the_operators_own_names(spark):
    rows = [(n, "word " * (n % 9), "ab"[n % 2], n, f"s{n}", -n, n, n, n) for n in range(60)]
    names = "doc_id long, text string, source string, _size long, _source string, _shards long, own long, point long, copy long"
    frame = spark.createDataFrame(rows, names)
    got = mixed(frame)
    assert got.columns == [*frame.columns, "__size", "_source_size", "_target", "_point", "__shards"]
    assert sorted(got.select(*frame.columns).collect()) == sorted(frame.collect())
    assert {r["__size"] for r in got.collect()} == set(range(9))
    out = shuffled_shards(got, frame.columns)
    assert out.columns == frame.columns and set(out.collect()) <= set(frame.collect())
    assert mixed(frame, keep=False).columns == ["doc_id", "_size", "_source_size", "_target", "_point", "_shards"]
