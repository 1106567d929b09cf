"""Load phases on small cases."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from adtally.operators import phases as module
from adtally.operators.lookup import Lookup
from adtally.operators.phases import Phase, assign_phase, fluctuating_load, phase_latency, phase_rates
from adtally.settings import RunSettings

T0 = datetime(2024, 1, 1, 0, 0, 3)


def at(*seconds):
    return [(T0 + timedelta(seconds=s),) for s in seconds]


def test_fluctuating_load():
    plan = fluctuating_load(T0, RunSettings(load_rate=50, reduced_load_rate=5, phase_seconds=40))
    assert [p.target_rate for p in plan] == [50, 5, 50]
    assert plan[0].end == plan[1].start and plan[2].end - plan[0].start == timedelta(seconds=120)


def test_rates_of_half_open_phases(spark):
    plan = fluctuating_load(T0, RunSettings(load_rate=0.1, reduced_load_rate=0, phase_seconds=40))
    events = spark.createDataFrame(at(-0.001, 0, 39.999999, 40, 119, 120), "event_time timestamp")
    got = [tuple(r) for r in phase_rates(events, plan).orderBy("phase").collect()]
    assert got == [
        (1, 2, 40.0, 0.1, 0.05, 0.5),
        (2, 1, 40.0, 0.0, 0.025, None),
        (3, 1, 40.0, 0.1, 0.025, 0.25),
    ]


@pytest.mark.parametrize("small", [True, False])
def test_uneven_gapped_and_overlapping_phases(spark, monkeypatch, small):
    """Brute force over every event and phase, through both ways of joining."""
    if not small:
        monkeypatch.setattr(module.Lookup, "bounded", classmethod(lambda c, f, k, rows, row_bytes: Lookup(f, tuple(k), False)))
    plan = [
        Phase(1, T0, T0 + timedelta(seconds=7), 1.0),
        Phase(2, T0 + timedelta(seconds=5.5), T0 + timedelta(seconds=600), 1.0),
        Phase(3, T0 + timedelta(seconds=900), T0 + timedelta(seconds=903.25), 1.0),
        Phase(4, T0 + timedelta(days=30), T0 + timedelta(days=31), 1.0),
    ]
    times = at(*[i * 0.75 - 20 for i in range(1400)])
    got = assign_phase(spark.createDataFrame(times, "t timestamp"), "t", plan).groupBy("phase").count()
    want = {p.phase: sum(p.start <= t < p.end for (t,) in times) for p in plan}
    assert {r["phase"]: r["count"] for r in got.collect()} == {k: v for k, v in want.items() if v}
    rates = phase_rates(spark.createDataFrame(times, "event_time timestamp"), plan)
    assert {r["phase"]: r["events"] for r in rates.collect()} == want


def test_phase_latency(spark):
    plan = fluctuating_load(datetime(2024, 1, 1), RunSettings(phase_seconds=40))
    windows = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 0, s), n, ms) for s, n, ms in ((0, 5, 100), (30, 7, 300), (50, 1, 50))],
        "window_start timestamp, seen_count long, last_event_lag_ms long",
    )
    got = [tuple(r) for r in phase_latency(windows, plan).orderBy("phase").collect()]
    assert got == [(1, 2, 12, 200.0, 300), (2, 1, 1, 50.0, 50)]


def test_a_short_phase_beside_a_long_one(spark):
    """The table of stretches grows with the number of phases, not with their lengths."""
    plan = [Phase(1, T0, T0 + timedelta(seconds=1), 1.0), Phase(2, T0, T0 + timedelta(days=365), 1.0)]
    rows = spark.createDataFrame(at(*range(0, 3_000, 3)), "event_time timestamp")
    got = {r["phase"]: r["events"] for r in phase_rates(rows, plan).collect()}
    assert got == {1: 1, 2: 1000}
    assert spark.createDataFrame([(None,)], "t timestamp").transform(lambda f: assign_phase(f, "t", plan)).count() == 0


def test_a_phase_must_have_length(spark):
    events = spark.createDataFrame(at(0), "event_time timestamp")
    with pytest.raises(ValueError):
        phase_rates(events, [Phase(1, T0, T0, 1.0)])
    assert events.select(F.count("event_time")).first()[0] == 1


def test_ten_thousand_phases(spark):
    """Against a search of sorted starts; the plan is as large as with three phases."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 10_000)
    starts = np.cumsum(lengths + rng.integers(0, 3, 10_000)) - lengths
    many = [Phase(n, T0 + timedelta(seconds=int(s)), T0 + timedelta(seconds=int(s + e)), 1.0) for n, (s, e) in enumerate(zip(starts, lengths))]
    times = rng.uniform(-50, starts[-1] + 500, 20_000).round(3)
    rows = spark.createDataFrame(at(*times.tolist()), "event_time timestamp").cache()
    rows.count()
    found = np.searchsorted(starts, times, "right") - 1
    inside = (found >= 0) & (times < (starts + lengths)[found])
    want = {n: int(c) for n, c in enumerate(np.bincount(found[inside], minlength=10_000))}
    assert {r["phase"]: r["events"] for r in phase_rates(rows, many).collect()} == want
    assert assign_phase(rows, "event_time", many).count() == inside.sum()

    def nodes(plan):
        return phase_rates(rows, plan)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    def seconds(plan):
        began = time.perf_counter()
        phase_rates(rows, plan).collect()
        return time.perf_counter() - began

    assert nodes(many) == nodes(many[:3])
    assert min(seconds(many) for _ in range(3)) < 2 * min(seconds(many[:3]) for _ in range(3)) + 0.5


def test_phases_on_a_stream(spark, tmp_path):
    plan = fluctuating_load(T0, RunSettings(phase_seconds=40))
    spark.createDataFrame(at(-1, 0, 39, 41, 200), "t timestamp").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("t timestamp").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = assign_phase(rows, "t", plan).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.start(out).awaitTermination()
    assert sorted(r.phase for r in spark.read.parquet(out).collect()) == [1, 1, 2]
