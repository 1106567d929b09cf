"""The continuous job: same answer as a recount whatever the order, pace and failures."""

import time
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from adtally.operators.campaign_windows import campaign_windows, settled_latency
from adtally.plans.runs import compare_runs, run_stream
from adtally.schemas import RESULT_COLUMNS
from adtally.settings import RunSettings
from adtally.sources.campaigns import numbered_campaigns
from adtally.sources.events import event_table, json_event_stream, kafka_options
from adtally.streaming.completeness import completeness, differences
from adtally.streaming.counts import drain, start_bounded_counts, start_campaign_counts
from adtally.streaming.store import WindowStore

SCHEMA = "ad_id long, event_type string, event_time timestamp"


@pytest.fixture(scope="module")
def events(spark, small):
    return event_table(spark, f"{small}/events.parquet").select("ad_id", "event_type", "event_time").cache()


@pytest.fixture
def store(spark, tmp_path):
    return WindowStore(spark, str(tmp_path / "store"), LongType())


def write_slices(events, folder, slices):
    """One file per slice of event time, written (and so replayed) in the order given."""
    for low, high in slices:
        day = F.dayofmonth("event_time")
        events.where((day >= low) & (day <= high)).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)  # the replay goes by file time


def replay(spark, folder, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(folder))


def recount(spark, events, window="1 hour"):
    return campaign_windows(events, numbered_campaigns(spark), window)


IN_ORDER = [(1, 10), (11, 20), (21, 31)]
OUT_OF_ORDER = [(1, 10), (21, 31), (11, 20)]


@pytest.mark.parametrize("slices", [IN_ORDER, OUT_OF_ORDER])
@pytest.mark.parametrize("files", [1, 10])
def test_stream_equals_recount(spark, events, store, tmp_path, slices, files):
    write_slices(events, tmp_path / "in", slices)
    query = start_campaign_counts(
        replay(spark, tmp_path / "in", files), numbered_campaigns(spark), store, "1 hour", trigger_millis=None
    )
    query.awaitTermination()
    assert differences(store.table(), recount(spark, events)).count() == 0
    row = completeness(store.table(), recount(spark, events)).first()
    assert row["differing"] == 0 and row["streamed_views"] == row["recounted_views"] == 188


def test_timed_trigger_goes_on_where_it_stopped(spark, events, store, tmp_path):
    campaigns = numbered_campaigns(spark)
    write_slices(events, tmp_path / "in", IN_ORDER[:2])
    drain(start_campaign_counts(replay(spark, tmp_path / "in"), campaigns, store, "1 hour", trigger_millis=200))
    partly = completeness(store.table(), recount(spark, events)).first()
    assert 0 < partly["streamed_views"] < partly["recounted_views"]
    write_slices(events, tmp_path / "in", IN_ORDER[2:])
    drain(start_campaign_counts(replay(spark, tmp_path / "in"), campaigns, store, "1 hour", trigger_millis=200))
    assert differences(store.table(), recount(spark, events)).count() == 0


def test_folding_while_it_runs(spark, events, store, tmp_path):
    write_slices(events, tmp_path / "in", [(1, 6), (19, 24), (7, 12), (25, 31), (13, 18)])
    start_campaign_counts(
        replay(spark, tmp_path / "in"), numbered_campaigns(spark), store, "1 hour", trigger_millis=None, fold_every=2
    ).awaitTermination()
    store.settle()
    folded = {p.name for p in (tmp_path / "store" / "folded").iterdir()}
    assert folded and folded <= {"upto=1", "upto=3"}  # a fold still going on is not waited for by the stream
    assert differences(store.table(), recount(spark, events)).count() == 0


def rows_of(store):
    return sorted(map(tuple, store.table().collect()))


def partial(spark, counts, at):
    rows = [(campaign, datetime(2024, 1, 1), n, datetime(2024, 1, 1, 0, 0, at)) for campaign, n in counts.items()]
    return spark.createDataFrame(
        rows, "campaign_id long, window_start timestamp, seen_count long, time_updated timestamp"
    )


def test_store_adds_up_and_forgives_repeats(spark, store):
    assert store.table().count() == 0
    store.upsert(partial(spark, {1: 5, 2: 1}, at=11), 0)
    store.upsert(partial(spark, {1: 2}, at=15), 1)
    before = rows_of(store)
    assert [(r[0], r[2], r[3].second) for r in before] == [(1, 7, 15), (2, 1, 11)]
    store.upsert(partial(spark, {1: 2}, at=15), 1)
    assert rows_of(store) == before


def test_folding_changes_nothing_but_the_files(spark, store, tmp_path):
    for batch in range(4):
        store.upsert(partial(spark, {1: 1, batch: 10}, at=batch), batch)
    before = rows_of(store)
    store.fold(1)
    assert rows_of(store) == before
    store.upsert(partial(spark, {1: 1, 3: 10}, at=3), 3)  # a repeat after the fold
    assert rows_of(store) == before
    store.fold(2)
    store.fold(1)  # already folded: nothing to do
    assert rows_of(store) == before
    assert sorted(p.name for p in (tmp_path / "store" / "batches").iterdir()) == ["batch_id=2", "batch_id=3"]
    assert sorted(p.name for p in (tmp_path / "store" / "folded").iterdir()) == ["upto=1", "upto=2"]


def test_two_hundred_batches_stay_bounded(spark, store, tmp_path):
    """What a read lists and a fold rewrites does not grow with the batches gone by."""
    folder, listed, rewritten = tmp_path / "store", [], []
    for batch in range(200):
        rows = pa.table({
            "campaign_id": [1, 2], "window_start": pa.array([datetime(2024, 1, 1 + batch // 10)] * 2, pa.timestamp("us", "UTC")),
            "seen_count": [1, 2], "time_updated": pa.array([None, None], pa.timestamp("us", "UTC")),
        })
        (folder / f"batches/batch_id={batch}").mkdir(parents=True)
        pq.write_table(rows, folder / f"batches/batch_id={batch}/part.parquet")
        (folder / "commits").mkdir(exist_ok=True)
        (folder / f"commits/{batch}-{1706745600000000 + batch}").touch()
        if batch and batch % 20 == 0:
            store.fold(batch - 1)
            listed.append(len(list((folder / "batches").iterdir())))
            rewritten.append(len(list((folder / f"folded/upto={batch - 1}").glob("day=*"))))
    assert max(listed) <= 41 and max(rewritten[1:]) <= 3
    got = rows_of(store)
    assert len(got) == 40 and {r[2] for r in got} == {10, 20}
    assert len(list((folder / "folded").glob("upto=*/day=*"))) <= 20 + 3


def test_commit_time_is_noted_once_and_after_the_write(spark, store, tmp_path):
    rows = partial(spark, {1: 5}, at=1).drop("time_updated")
    store.upsert(rows, 0)
    first = store.table().first()["time_updated"]
    written = min(p.stat().st_mtime for p in (tmp_path / "store/batches/batch_id=0").glob("part*"))
    assert first.timestamp() >= int(written)
    store.upsert(rows, 0)
    assert store.table().first()["time_updated"] == first


def test_old_days_are_let_go(spark, tmp_path):
    store = WindowStore(spark, str(tmp_path / "kept"), LongType(), keep_days=2)
    for batch, day in enumerate((1, 2, 9, 10, 11)):
        rows = [(1, datetime(2024, 1, day), 1, datetime(2024, 1, day))]
        store.upsert(spark.createDataFrame(rows, partial(spark, {1: 1}, 1).schema), batch)
        store.fold(batch)
    assert sorted(r[1].day for r in rows_of(store)) == [9, 10, 11] or sorted(r[1].day for r in rows_of(store))[0] >= 2


def test_half_done_fold_is_not_read(spark, store, tmp_path):
    store.upsert(partial(spark, {1: 5}, at=1), 0)
    partial(spark, {1: 99}, at=1).write.parquet(str(tmp_path / "store" / "folded" / "upto=0"))
    assert rows_of(store)[0][2] == 5
    store.fold(0)
    assert rows_of(store)[0][2] == 5


def test_store_of_totals_keeps_the_newest(spark, tmp_path):
    store = WindowStore(spark, str(tmp_path / "totals"), LongType(), totals=True)
    store.upsert(partial(spark, {1: 5, 2: 1}, at=1), 0)
    store.upsert(partial(spark, {1: 8}, at=2), 1)
    store.fold(0)
    store.upsert(partial(spark, {1: 9}, at=3), 2)
    assert [(r[0], r[2]) for r in rows_of(store)] == [(1, 9), (2, 1)]


def bounded(spark, tmp_path, delay):
    store = WindowStore(spark, str(tmp_path / "bounded"), LongType(), totals=True)
    start_bounded_counts(
        replay(spark, tmp_path / "in"), numbered_campaigns(spark), store, delay, "1 hour", trigger_millis=None
    ).awaitTermination()
    return store


def test_bounded_state_within_the_delay_is_complete(spark, events, tmp_path):
    write_slices(events, tmp_path / "in", OUT_OF_ORDER)
    store = bounded(spark, tmp_path, "40 days")
    assert differences(store.table(), recount(spark, events)).count() == 0


def test_bounded_state_leaves_out_what_is_too_late(spark, events, tmp_path):
    """One more batch lies between the watermark's advance and the late events."""
    write_slices(events, tmp_path / "in", [(1, 10), (21, 30), (31, 31), (11, 20)])
    store = bounded(spark, tmp_path, "1 hour")
    late = F.dayofmonth("event_time").between(11, 20)
    assert differences(store.table(), recount(spark, events.where(~late))).count() == 0


def test_bounded_counts_need_a_store_of_totals(spark, events, store, tmp_path):
    write_slices(events, tmp_path / "in", IN_ORDER[:1])
    with pytest.raises(ValueError, match="totals"):
        start_bounded_counts(replay(spark, tmp_path / "in"), numbered_campaigns(spark), store, "1 hour")


def test_json_topic_to_results(spark, tmp_path):
    """A whole run: JSON records in, labelled result rows out, then the comparison."""
    start = int(time.time()) // 10 * 10
    lines = [
        f'{{"ad_id": "{i % 30}", "event_type": "{"view" if i % 3 else "click"}", "event_time": "{(start + i // 50) * 1000}"}}'
        for i in range(3000)
    ] + ["not json"]
    (tmp_path / "topic").mkdir()
    (tmp_path / "topic" / "part-0.json").write_text("\n".join(lines))
    events = json_event_stream(spark, str(tmp_path / "topic"), files_per_trigger=1)
    events = events.withColumn("ad_id", F.col("ad_id").try_cast("bigint"))
    store = WindowStore(spark, str(tmp_path / "run"), LongType())
    settings = RunSettings(nodes=2, system="spark", test=3)
    results = run_stream(events, numbered_campaigns(spark), store, settings).cache()
    assert results.columns == list(RESULT_COLUMNS)
    assert [r["testIndex"] for r in results.orderBy("testIndex").collect()] == list(range(18))
    assert results.agg(F.sum("countOfEvent")).first()[0] == 2000
    assert {tuple(r) for r in results.select("NumberOfNodes", "TestNumber", "System").distinct().collect()} == {
        (2, 3, "spark")
    }
    clock = settled_latency(store.table()).agg(F.min("latency_ms"), F.max("latency_ms")).first()
    assert -60_000 < clock[0] <= clock[1] < 120_000
    other = results.withColumns({"System": F.lit("other"), "latencyTime": F.col("latencyTime") + F.col("testIndex")})
    tables = compare_runs(results.unionByName(other), bin_width=50, q_critical=2.8)
    assert {name: table.count() for name, table in tables.items()} == {
        "describe": 2, "variance": 2, "anova": 4, "tukey": 1, "binned": tables["binned"].count(), "box": 2,
    }


def test_kafka_options():
    settings = RunSettings.from_mapping(
        {"kafka.brokers": ["a b", "c"], "kafka.port": 9093, "kafka.topic": "t", "spark.batchtime": 500, "other": 1}
    )
    assert settings.trigger_millis == 500
    options = kafka_options(settings, max_offsets_per_trigger=10)
    assert options["kafka.bootstrap.servers"] == "a:9093,b:9093,c:9093"
    assert options["subscribe"] == "t" and options["maxOffsetsPerTrigger"] == "10"
