"""Summaries and comparisons against numpy on small cases."""

from math import sqrt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adtally.operators import comparisons, connected, quantiles
from adtally.operators.comparisons import anova_two_way, tukey_hsd
from adtally.operators.summaries import binned_mean, box_stats, describe_by_group, variance_by_group

rng = np.random.default_rng(7)


def awkward():
    """Groups with ties, heavy tails, one row, two rows, negative and missing values."""
    return pd.concat(
        [
            pd.DataFrame({"g": "ties", "y": np.repeat([1.0, 2.0, 2.0, 5.0], 250)}),
            pd.DataFrame({"g": "tail", "y": rng.pareto(0.5, 3000)}),
            pd.DataFrame({"g": "one", "y": [3.5]}),
            pd.DataFrame({"g": "two", "y": [1.0, 4.0]}),
            pd.DataFrame({"g": "sign", "y": rng.normal(0, 1, 999).round(2)}),
            pd.DataFrame({"g": "hole", "y": [1.0, np.nan, 2.0, np.nan]}),
        ]
    )


@pytest.fixture(scope="module")
def table(spark):
    local = awkward()
    return local, spark.createDataFrame(local).repartition(5)


def test_describe(table):
    local, frame = table
    got = describe_by_group(frame, ["g"], "y").toPandas().set_index("g").sort_index()
    want = local.groupby("g")["y"].describe()
    want.columns = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    pd.testing.assert_frame_equal(got.astype(float), want[got.columns].sort_index(), check_names=False, rtol=1e-12)


def test_a_sketch_that_misses_does_not_matter(table, monkeypatch):
    """Brackets of no use at all: every rank is fetched in the third pass."""
    local, frame = table
    monkeypatch.setattr(quantiles, "_in_bracket", lambda probes: quantiles.F.lit(False))
    got = describe_by_group(frame, ["g"], "y").toPandas().set_index("g").sort_index()
    want = local.groupby("g")["y"].describe()
    for mine, theirs in (("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        np.testing.assert_allclose(got[mine], want[theirs].sort_index(), rtol=1e-12)


def test_approximate_describe_is_close(table):
    _, frame = table
    row = describe_by_group(frame, ["g"], "y", approximate=True).where("g = 'ties'").first()
    assert (row["p25"], row["p50"], row["p75"]) == (1.0, 2.0, 2.0)


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, y double")
    assert describe_by_group(empty, ["g"], "y").count() == 0
    assert box_stats(empty, ["g"], "y").count() == 0


def test_infinite_values_keep_their_quantiles(spark):
    inf = float("inf")
    frame = spark.createDataFrame([("a", v) for v in (1.0, inf, inf, inf)] + [("b", -inf), ("b", 2.0)], "g string, y double")
    got = {r["g"]: r for r in describe_by_group(frame, ["g"], "y").collect()}
    assert (got["a"]["p50"], got["a"]["p75"], got["a"]["max"]) == (inf, inf, inf)
    assert got["b"]["min"] == -inf and got["b"]["count"] == 2


def test_groups_without_values_stay(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("gone", None), ("gone", float("nan")), (None, 1.0)], "g string, y double")
    got = {r["g"]: r for r in describe_by_group(frame, ["g"], "y").collect()}
    assert set(got) == {"a", "gone"} and got["gone"]["count"] == 0
    assert all(got["gone"][c] is None for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    assert {r["g"]: r["variance"] for r in variance_by_group(frame, ["g"], "y").collect()} == {"a": 2.0, "gone": None}


def test_one_group_over_many_tasks(spark):
    """A bucket's values are numbered across tasks: many values, every quantile exact."""
    frame = spark.range(20_000).selectExpr("'g' AS g", "CAST(pmod(id * 7919, 20011) AS DOUBLE) AS y").repartition(7)
    row = describe_by_group(frame, ["g"], "y").first()
    y = np.array([r.y for r in frame.collect()])
    np.testing.assert_allclose([row["p25"], row["p50"], row["p75"]], np.percentile(y, [25, 50, 75]), rtol=1e-12)


def test_variance(table):
    local, frame = table
    got = variance_by_group(frame, ["g"], "y").toPandas().set_index("g")["variance"].astype(float)
    want = local.groupby("g")["y"].var()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False, rtol=1e-10)


def test_box(table):
    local, frame = table
    got = box_stats(frame, ["g"], "y").toPandas().set_index("g")
    assert set(got.index) == set(local["g"])
    for name, y in local.dropna().groupby("g")["y"]:
        q1, q2, q3 = np.percentile(y, [25, 50, 75])
        inside = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
        want = [q1, q2, q3, inside.min(), inside.max(), len(y) - len(inside)]
        np.testing.assert_allclose(got.loc[name].astype(float), want, rtol=1e-12)


def test_binned_mean(spark):
    frame = spark.createDataFrame([(-0.5, 1.0), (0.0, 2.0), (4.9, 4.0), (5.0, 8.0), (5.0, None)], "x double, y double")
    got = sorted(map(tuple, binned_mean(frame, "x", "y", 5).collect()))
    assert got == [(-5.0, 1, 1.0), (0.0, 2, 3.0), (5.0, 1, 8.0)]


def least_squares_anova(local, a, b, y):
    """Type II sums of squares by fitting the nested models row by row."""

    def rss(*factors):
        columns = [np.ones(len(local))] + [
            (local[list(f)].astype(str).agg("|".join, axis=1) == level).to_numpy(float)
            for f in factors
            for level in local[list(f)].astype(str).agg("|".join, axis=1).unique()
        ]
        x = np.column_stack(columns)
        centred = local[y] - local[y].mean()
        return float(((centred - x @ np.linalg.lstsq(x, centred, rcond=None)[0]) ** 2).sum())

    both = rss((a,), (b,))
    return {a: rss((b,)) - both, b: rss((a,)) - both, f"{a}:{b}": both - rss((a, b)), "Residual": rss((a, b))}


def unbalanced(levels_a, levels_b, offset=0.0):
    n = 600
    a, b = rng.integers(0, levels_a, n), rng.integers(0, levels_b, n)
    keep = ~((a == 0) & (b == levels_b - 1))  # an empty cell
    y = offset + 3 * a + 5 * b + 2 * a * b + rng.normal(0, 4, n)
    return pd.DataFrame({"a": a, "b": b, "y": y})[keep]


@pytest.mark.parametrize("levels", [(3, 2), (2, 4), (4, 3), (2, 2)])
@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_anova(spark, levels, offset):
    local = unbalanced(*levels, offset)
    got = {row["term"]: row for row in anova_two_way(spark.createDataFrame(local), "a", "b", "y").collect()}
    want = least_squares_anova(local, "a", "b", "y")
    cells = len(local.groupby(["a", "b"]))
    df = {
        "a": levels[0] - 1, "b": levels[1] - 1,
        "a:b": cells - sum(levels) + 1, "Residual": len(local) - cells,
    }
    error = want["Residual"] / df["Residual"]
    for term, row in got.items():
        assert row["df"] == df[term]
        if not df[term]:
            assert row["f"] is None and row["sum_sq"] == 0
            continue
        np.testing.assert_allclose(row["sum_sq"], want[term], rtol=1e-6, atol=1e-6)
        if term != "Residual":
            np.testing.assert_allclose(row["f"], want[term] / df[term] / error, rtol=1e-6)


def test_anova_of_many_levels(spark):
    """A design the normal equations of which would not be solved as one small matrix on both sides."""
    n = 6_000
    local = pd.DataFrame({"a": rng.integers(0, 500, n), "b": rng.integers(0, 3, n)})
    local["y"] = local.a % 7 + 2.0 * local.b + rng.normal(0, 1, n)
    got = {r["term"]: r for r in anova_two_way(spark.createDataFrame(local), "a", "b", "y").collect()}
    x = pd.get_dummies(local.a).to_numpy(float)
    z = pd.get_dummies(local.b).to_numpy(float)
    y = local.y - local.y.mean()

    def rss(design):
        return float(((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum())

    both = rss(np.hstack([x, z]))
    np.testing.assert_allclose(got["a"]["sum_sq"], rss(z) - both, rtol=1e-8)
    np.testing.assert_allclose(got["b"]["sum_sq"], rss(x) - both, rtol=1e-8)
    assert got["a"]["df"] == 499 and got["b"]["df"] == 2


def test_anova_of_one_level(spark):
    local = pd.DataFrame({"nodes": 2, "system": ["s"] * 5 + ["f"] * 5, "y": np.arange(10.0) ** 2})
    got = {r["term"]: r for r in anova_two_way(spark.createDataFrame(local), "nodes", "system", "y").collect()}
    assert (got["nodes"]["df"], got["nodes"]["sum_sq"], got["nodes"]["f"]) == (0, 0.0, None)
    assert got["nodes:system"]["f"] is None
    between = 5 * ((local.y[:5].mean() - local.y.mean()) ** 2 + (local.y[5:].mean() - local.y.mean()) ** 2)
    assert got["system"]["sum_sq"] == pytest.approx(between)
    assert got["system"]["f"] > 0


def test_anova_rejects_unconnected_designs(spark):
    apart = pd.DataFrame({"a": [1, 1, 2, 2], "b": ["x", "x", "y", "y"], "y": [1.0, 2.0, 3.0, 5.0]})
    with pytest.raises(ValueError, match="not connected"):
        anova_two_way(spark.createDataFrame(apart), "a", "b", "y")
    more = pd.DataFrame({"a": [1, 2, 3, 3], "b": ["x", "y", "z", "x"], "y": [1.0, 2.0, 3.0, 5.0]})
    with pytest.raises(ValueError, match="not connected"):
        anova_two_way(spark.createDataFrame(more), "a", "b", "y")
    with pytest.raises(ValueError, match="no rows"):
        anova_two_way(spark.createDataFrame(apart).limit(0), "a", "b", "y")


def test_tukey(spark):
    local = pd.DataFrame(
        {"g": list("aaabbbbcc"), "y": [1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 5.0, 9.0, 11.0]}
    )
    got = {(r["group1"], r["group2"]): r for r in tukey_hsd(spark.createDataFrame(local), "g", "y", 4.339).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = local.groupby("g")["y"]
    mse = groups.apply(lambda y: ((y - y.mean()) ** 2).sum()).sum() / 6
    for (one, two), row in got.items():
        scale = sqrt(mse / 2 * (1 / len(groups.get_group(one)) + 1 / len(groups.get_group(two))))
        gap = groups.get_group(two).mean() - groups.get_group(one).mean()
        assert row["df"] == 6
        assert row["meandiff"] == pytest.approx(gap)
        assert row["q"] == pytest.approx(abs(gap) / scale)
        assert (row["lower"], row["upper"]) == pytest.approx((gap - 4.339 * scale, gap + 4.339 * scale))
        assert row["reject"] == (abs(gap) / scale > 4.339)


def test_tukey_judges_any_sample(spark):
    """Small samples and many groups get verdicts too."""
    local = pd.DataFrame({"g": [f"{i:02d}" for i in range(15)] * 4, "y": rng.normal(0, 1, 60)})
    got = tukey_hsd(spark.createDataFrame(local), "g", "y", 5.0).collect()
    assert len(got) == 105 and all(r["reject"] is not None and r["lower"] < r["upper"] for r in got)


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_components_of_a_long_path(spark, order):
    """A thousand levels in a row, each sharing a group with the next: rounds are few."""
    names = np.arange(1_000)
    if order == "shuffled":
        np.random.default_rng(2).shuffle(names)
    members = [(g, int(names[n])) for g in range(999) for n in (g, g + 1)]
    assert connected.count_components(spark.createDataFrame(members, "group long, node long"), 1_000)[0] == 1
    cut = [(g, n) for g, n in members if g not in (100, 500, 501)]
    pieces, tables = connected.count_components(spark.createDataFrame(cut, "group long, node long"), len({n for _, n in cut}))
    # Where 500 and 501 are left out, one level has no group and is no node.
    assert pieces == 3 and tables <= 40


def test_anova_of_a_chain_of_levels(spark):
    """Twelve levels of which only neighbours meet."""
    rng = np.random.default_rng(6)
    local = pd.DataFrame([(f"a{k:02d}", f"b{k + step:02d}", rng.normal() + k) for k in range(12) for step in (0, 1) for _ in range(3)], columns=["a", "b", "y"])
    got = {r["term"]: r for r in anova_two_way(spark.createDataFrame(local), "a", "b", "y").collect()}
    want = least_squares_anova(local, "a", "b", "y")
    for term, sum_sq in want.items():
        np.testing.assert_allclose(got[term]["sum_sq"], sum_sq, rtol=1e-7, atol=1e-8)


def test_unsolved_models_are_an_error(spark, monkeypatch):
    rng = np.random.default_rng(6)
    local = pd.DataFrame([(f"a{k}", f"b{k + step}", rng.normal()) for k in range(9) for step in (0, 1) for _ in range(2)], columns=["a", "b", "y"])
    monkeypatch.setattr(comparisons, "SOLVED", 0.5)
    with pytest.raises(ArithmeticError, match="not solved"):
        anova_two_way(spark.createDataFrame(local), "a", "b", "y")


def test_pairs_of_many_groups(spark):
    """Each pair once, in the order of names, made by many tasks."""
    groups = spark.range(700).selectExpr("concat('g', id) AS name", "1L AS n", "id * 1.0 AS mean")
    pairs = comparisons._pairs(groups, 700)
    assert pairs.rdd.getNumPartitions() >= 15
    row = pairs.agg(F.count("*").alias("n"), F.count_distinct("one.name", "two.name").alias("pairs"), F.count_if(F.col("one.name") >= F.col("two.name")).alias("odd")).first()
    assert tuple(row) == (700 * 699 // 2, 700 * 699 // 2, 0)
    made = pairs.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert made < 0.5 * 700 * 699 / 2
