"""The store's manifest, its closed days, its fingerprints and its sketches."""

import json
import math
import random
import threading
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from adtally.operators.campaign_windows import campaign_windows
from adtally.operators.lookup import Lookup
from adtally.operators.sketches import ACCURACY, merge_sketches, sketch_of, sketch_quantiles
from adtally.operators.summaries import describe_by_group
from adtally.sources.campaigns import numbered_campaigns
from adtally.streaming.completeness import (
    completeness,
    differences,
    event_day_marks,
    parity_by_day,
    store_completeness,
    store_differences,
)
from adtally.streaming.store import Manifest, WindowStore

ROWS = "campaign_id long, window_start timestamp, seen_count long, time_updated timestamp"


def put(store, batch, *rows):
    """Rows of (campaign, day, count), at noon; updated an hour later."""
    at = [(c, datetime(2024, 1, 1, 12) + timedelta(days=d), n, datetime(2024, 1, 1, 13) + timedelta(days=d)) for c, d, n in rows]
    store.upsert(store.spark.createDataFrame(at, ROWS), batch)


def counts(store):
    return {(r.campaign_id, (r.window_start - datetime(2024, 1, 1, 12)).days): r.seen_count for r in store.table().collect()}


def listing(folder):
    return sum(1 for p in folder.rglob("*"))


@pytest.fixture
def store(spark, tmp_path):
    return WindowStore(spark, str(tmp_path / "store"), LongType(), keep_days=3)


# ---------------------------------------------------------------- the manifest


def test_listing_stays_flat_over_folds(spark, store, tmp_path):
    """Folds with rows, then two hundred new states: what lies in the folder does not grow."""
    sizes = []
    for batch in range(12):
        put(store, batch, (1, batch // 2, 1), (2, batch // 2, 1))
        store.fold(batch)
        sizes.append(listing(tmp_path / "store"))
    assert max(sizes[8:]) <= max(sizes[4:8])
    before, kept = listing(tmp_path / "store"), counts(store)
    for _ in range(200):
        state = store._state()
        now = Manifest(**{**vars(state), "version": state.version + 1})
        assert store._files.write_new(store._manifests, f"{now.version:012d}.json", json.dumps(vars(now)))
        store._forget(state, now)
    assert listing(tmp_path / "store") <= before and counts(store) == kept
    assert len([p for p in (tmp_path / "store/manifests").iterdir() if p.name[0].isdigit()]) == 2


def test_a_state_is_replaced_whole(spark, store, tmp_path):
    """A fold that dies before its manifest leaves the state before, and is done again."""
    put(store, 0, (1, 0, 5))
    store.fold(0)
    put(store, 1, (1, 0, 2), (1, 1, 7))
    before = counts(store)
    write, store._files.write_new = store._files.write_new, None
    with pytest.raises(TypeError):
        store.fold(1)
    store._files.write_new = write
    assert counts(store) == before
    (tmp_path / "store/manifests/_000000000009.json-torn").write_text('{"version": 9, "da')
    assert counts(store) == before
    store.fold(1)
    assert counts(store) == before == {(1, 0): 7, (1, 1): 7}


def test_two_writers_of_one_state(spark, store):
    put(store, 0, (1, 0, 5))
    store.fold(0)
    other = WindowStore(spark, store.folder, LongType())
    put(store, 1, (1, 0, 1))
    seen, other._state = other._state(), lambda: seen
    store.fold(1)
    with pytest.raises(RuntimeError, match="another job"):
        other.fold(1)
    assert counts(store) == {(1, 0): 6}


def test_a_batch_without_its_note_is_not_read(spark, store, tmp_path):
    put(store, 0, (1, 0, 5))
    store.table().limit(0).write.parquet(str(tmp_path / "store/batches/batch_id=1"))
    store.spark.createDataFrame([(1, datetime(2024, 1, 1, 12), 9, None)], ROWS).write.mode("append").parquet(str(tmp_path / "store/batches/batch_id=1"))
    assert counts(store) == {(1, 0): 5}
    put(store, 1, (1, 0, 9))
    assert counts(store) == {(1, 0): 14}


def test_no_thread_is_left(spark, store):
    put(store, 0, (1, 0, 5))
    before = threading.active_count()
    store.fold_later(0)
    store.settle()
    assert threading.active_count() <= before
    store._folding = None
    put(store, 1, (1, 0, 5))
    store.fold = None  # a fold's error comes out when it is waited for
    store.fold_later(1)
    with pytest.raises(TypeError):
        store.settle()


# ---------------------------------------------------------------- closed days


def test_late_rows_do_not_start_a_closed_window_anew(spark, store):
    put(store, 0, (1, 0, 100))
    store.fold(0)
    put(store, 1, (1, 9, 1))
    store.fold(1)
    assert counts(store) == {(1, 9): 1} and store.refused().collect() == []
    put(store, 2, (1, 0, 1), (2, 0, 4), (1, 6, 3))
    assert counts(store) == {(1, 9): 1, (1, 6): 3}
    want = [(date(2024, 1, 1), 2, 5)]
    assert [tuple(r) for r in store.refused().collect()] == want  # not folded yet
    store.fold(2)
    assert counts(store) == {(1, 9): 1, (1, 6): 3} and [tuple(r) for r in store.refused().collect()] == want
    put(store, 3, (1, 0, 1))
    store.fold(3)
    assert [tuple(r) for r in store.refused().collect()] == [(date(2024, 1, 1), 3, 6)]


def test_the_horizon_never_goes_back(spark, store):
    put(store, 0, (1, 10, 1))
    store.fold(0)
    open_from = store._state().horizon
    put(store, 1, (1, 8, 1), (1, 2, 1))
    store.fold(1)
    assert store._state().horizon == open_from == "2024-01-08" and counts(store) == {(1, 10): 1, (1, 8): 1}
    far = (date.today() - date(2024, 1, 1)).days + 4000
    put(store, 2, (1, far, 1))  # a clock far ahead closes nothing
    store.fold(2)
    assert store._state().horizon == open_from and counts(store)[1, 10] == 1


def test_refused_counts_stay_short(spark, store):
    put(store, 0, (1, 1000, 1))
    store.fold(0)
    old = [(1, d, 1) for d in range(0, 997, 2)]
    put(store, 1, *old)
    store.fold(1)
    state = store._state()
    horizon = (date.fromisoformat(state.horizon) - date(2024, 1, 1)).days
    assert len(state.refused) <= 402 and sum(n for n, _ in state.refused.values()) == sum(d < horizon for _, d, _ in old)
    assert store.refused().agg(F.sum("views")).first()[0] == sum(d < horizon for _, d, _ in old)


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_batches_and_folds(spark, tmp_path, seed):
    """Against a plain model: what is open adds up, what is closed is counted as refused."""
    rng = random.Random(seed)
    store = WindowStore(spark, str(tmp_path / "store"), LongType(), keep_days=2)
    table, refused, horizon, waiting = {}, {}, -1000, []
    for batch in range(6):
        rows = [(rng.randint(1, 2), max(0, batch + rng.choice([-5, -2, -1, 0, 0, 1])), rng.randint(1, 9)) for _ in range(4)]
        merged = {}
        for c, d, n in rows:
            merged[c, d] = merged.get((c, d), 0) + n
        put(store, batch, *[(c, d, n) for (c, d), n in merged.items()])
        waiting += merged.items()
        if rng.random() < 0.6:
            store.fold(batch)
            came = [(k, n) for k, n in waiting if k[1] >= horizon]
            for (_, d), n in ((k, n) for k, n in waiting if k[1] < horizon):
                refused[d] = refused.get(d, 0) + n
            horizon = max(horizon, max([d for (_, d), _ in came] + [d for _, d in table], default=-1000) - 2)
            for k, n in came:
                table[k] = table.get(k, 0) + n
            table, waiting = {k: n for k, n in table.items() if k[1] >= horizon}, []
        shown, late = dict(table), dict(refused)
        for (c, d), n in waiting:
            if d >= horizon:
                shown[c, d] = shown.get((c, d), 0) + n
            else:
                late[d] = late.get(d, 0) + n
        assert counts(store) == shown
        assert {(r.day - date(2024, 1, 1)).days: r.views for r in store.refused().collect()} == late


# ---------------------------------------------------------------- fingerprints


def events_of(spark, rows):
    """(ad, day, hour, how many) views."""
    frame = spark.createDataFrame([(a, datetime(2024, 1, 1) + timedelta(days=d, hours=h), n) for a, d, h, n in rows], "ad_id long, event_time timestamp, n int")
    return frame.select("ad_id", F.lit("view").alias("event_type"), "event_time", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


VIEWS = [(a, d, h, 1 + (a * d + h) % 4) for a in (3, 17, 25) for d in range(5) for h in (0, 11, 23)]


def filled(spark, folder, views, folds=True):
    store = WindowStore(spark, str(folder), LongType())
    windows = campaign_windows(events_of(spark, views), numbered_campaigns(spark), "1 hour").drop("last_event_time")
    store.upsert(windows.where(F.dayofmonth("window_start") <= 3), 0)
    if folds:
        store.fold(0)
    store.upsert(windows.where(F.dayofmonth("window_start") > 3), 1)
    return store


@pytest.mark.parametrize("folds", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_equal_days_have_equal_fingerprints(spark, tmp_path, folds, small):
    store, events = filled(spark, tmp_path / "s", VIEWS, folds), events_of(spark, VIEWS)
    table = numbered_campaigns(spark)
    campaigns = Lookup(table.frame, table.keys, small)
    days = parity_by_day(store.day_marks(), events, campaigns, "1 hour").collect()
    assert len(days) == 5 and all(r.same and r.streamed_views == r.recounted_views > 0 for r in days)
    recounted = campaign_windows(events, campaigns, "1 hour")
    assert store_completeness(store, events, campaigns, "1 hour").collect() == completeness(store.table(), recounted).collect()
    assert store_differences(store, events, campaigns, "1 hour").count() == 0


@pytest.mark.parametrize("change", ["lost", "moved", "other campaign", "lost day", "new day"])
def test_a_differing_day_is_found(spark, tmp_path, change):
    store, other = filled(spark, tmp_path / "s", VIEWS), list(VIEWS)
    a, d, h, n = other[7]
    if change == "lost day":
        other = [v for v in other if v[1] != d]
    else:
        other[7] = {"lost": (a, d, h, n - 1 or n + 1), "moved": (a, d, h + 1, n), "other campaign": (a + 10, d, h, n), "new day": (a, d, h, n)}[change]
    if change == "new day":
        other.append((a, 9, 0, 1))
        d = 9
    events, campaigns = events_of(spark, other), numbered_campaigns(spark)
    odd = [r.day for r in parity_by_day(store.day_marks(), events, campaigns, "1 hour").where("NOT same").collect()]
    assert odd == [date(2024, 1, 1) + timedelta(days=d)]
    recounted = campaign_windows(events, campaigns, "1 hour")
    want = sorted(map(str, differences(store.table(), recounted).collect()))
    assert sorted(map(str, store_differences(store, events, campaigns, "1 hour").collect())) == want != []
    assert store_completeness(store, events, campaigns, "1 hour").collect() == completeness(store.table(), recounted).collect()


def test_a_clean_check_reads_no_window(spark, tmp_path):
    store, events = filled(spark, tmp_path / "s", VIEWS), events_of(spark, VIEWS)
    store.fold(1)
    store.table = None  # would fail
    assert store_completeness(store, events, numbered_campaigns(spark), "1 hour").first().differing == 0
    plan = parity_by_day(store.day_marks(), events, numbered_campaigns(spark), "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "folded" not in plan and "window_start" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    marks = event_day_marks(events, numbered_campaigns(spark), "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert marks.count("Exchange hashpartitioning") == 1


# ---------------------------------------------------------------- sketches


def test_sketches_are_within_their_accuracy(spark):
    """Any doubles: tiny, huge, negative, equal, and groups of one."""
    rng, probs = np.random.default_rng(5), [0.0, 0.25, 0.5, 0.99, 1.0]
    groups = [[1.7e308, -1.7e308], [0.0], [-0.0, 5e-324, 2.3e-308], [3.0] * 50, list(range(-40, 60)), list(10 ** rng.uniform(-300, 300, 80))]
    groups += [list(rng.normal(size=int(n)) * 10.0 ** int(e)) for n, e in zip(rng.integers(1, 60, 12), rng.integers(-9, 9, 12))]
    rows = spark.createDataFrame([(g, float(v)) for g, values in enumerate(groups) for v in values], "g int, y double")
    for r in sketch_quantiles(sketch_of(rows, ["g"], "y"), ["g"], probs).collect():
        values = sorted(map(float, groups[r["g"]]))
        assert r["rows"] == len(values)
        for p, q in zip(probs, r.quantiles):
            true = values[math.floor(p * (len(values) - 1))]
            assert abs(q - true) <= ACCURACY * abs(true) * (1 + 1e-9) + 1e-300


def test_sketches_add_up(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(n % 3), float(v)) for n, v in enumerate(rng.lognormal(5, 2, 3_000))] + [(0, None), (1, float("nan")), (2, float("inf")), (2, 0.0)], "k int, y double")
    whole = sketch_of(rows, [], "y")
    parts = merge_sketches(sketch_of(rows, ["k"], "y"), [])
    assert sorted(whole.collect()) == sorted(parts.collect())
    exact = describe_by_group(rows.where("y < 1e300").withColumn("all", F.lit(1)), ["all"], "y").first()
    got = sketch_quantiles(sketch_of(rows.where("y < 1e300"), [], "y"), [], [0.25, 0.5, 0.75]).first().quantiles
    np.testing.assert_allclose(got, [exact.p25, exact.p50, exact.p75], rtol=2 * ACCURACY)


def test_latency_of_a_running_store(spark, tmp_path):
    """Days with nothing new are not read again; the rest is merged in."""
    store = WindowStore(spark, str(tmp_path / "s"), LongType())
    rng = np.random.default_rng(2)
    rows = [(int(c), datetime(2024, 1, 1 + d), 1, datetime(2024, 1, 1 + d) + timedelta(milliseconds=int(ms)))
            for d in range(4) for c, ms in enumerate(rng.lognormal(8, 1, 200))]
    store.upsert(spark.createDataFrame(rows[:600], ROWS), 0)
    store.fold(0)
    store.upsert(spark.createDataFrame(rows[500:], ROWS), 1)
    latest = {(c, s): (u - s) / timedelta(milliseconds=1) for c, s, _, u in rows}
    want = np.quantile(sorted(latest.values()), [0.5, 0.99], method="lower")
    got = store.latency_quantiles([0.5, 0.99]).first()
    assert got["rows"] == 800
    np.testing.assert_allclose(got.quantiles, want, rtol=ACCURACY * 1.001)
    plan = store.latency_sketch()._jdf.queryExecution().optimizedPlan().toString()
    assert store._fresh_days() == ["2024-01-03", "2024-01-04"] and "seen_count" in plan
    store.fold(1)
    plan = store.latency_sketch()._jdf.queryExecution().optimizedPlan().toString()
    assert "seen_count" not in plan and "window_start" not in plan
    by_day = store.latency_quantiles([0.5], by_day=True).collect()
    assert {r["day"].day: r["rows"] for r in by_day} == {1: 200, 2: 200, 3: 200, 4: 200}
    np.testing.assert_allclose(store.latency_quantiles([0.5, 0.99]).first().quantiles, want, rtol=ACCURACY * 1.001)
