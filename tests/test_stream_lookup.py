"""Lookups on streams with tables that are not broadcast."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from adtally.operators.campaign_windows import campaign_windows
from adtally.operators.hot_keys import KeyTally, watched
from adtally.operators.lookup import HOT_PART, Lookup, attach
from adtally.sources.campaigns import numbered_campaigns
from adtally.sources.events import event_table
from adtally.streaming.completeness import differences
from adtally.streaming.counts import start_bounded_counts
from adtally.streaming.joins import TallyFile, start_attached
from adtally.streaming.store import WindowStore

SCHEMA = "ad_id long, event_type string, event_time timestamp"


def large(table):
    return Lookup(table.frame, table.keys, small=False)


def test_a_tally_holds_every_heavy_key():
    """Any order of batches, whatever fits: no key over its bound is missing, no count is too high."""
    rng = random.Random(4)
    for size in (3, 10, 50):
        tally, other, true = KeyTally(size=size), KeyTally(size=size), {}
        for batch in range(30):
            counts = {rng.randint(1, 8) ** 3: rng.randint(1, 50) for _ in range(12)} | {7: 40}
            for key, n in counts.items():
                true[key] = true.get(key, 0) + n
            (tally if batch % 2 else other).merge(counts, sum(counts.values()))
        tally.merge(other.counts, other.total, other.error)
        total = sum(true.values())
        assert tally.total == total and len(tally.counts) <= size and tally.error <= total / size
        for key, n in true.items():
            assert n - tally.error <= tally.counts.get(key, 0) <= n
            if n > total / size:
                assert key in tally.counts
        assert KeyTally.from_json(tally.to_json()) == tally
    assert KeyTally().hot(0.01) == []


def test_rows_tell_their_heavy_keys(spark):
    facts = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS v").repartition(6)
    shown, tally = Observation(), KeyTally()
    assert watched(facts, ["k"], "unread").columns == ["k", "v"]
    watched(facts, ["k"], shown).write.format("noop").mode("overwrite").save()
    tally.add(shown.get)
    key = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert tally.total == 30_000 and tally.hot(HOT_PART) == [key] and tally.counts[key] >= 10_000
    table = Lookup(spark.range(40_000).selectExpr("id AS k", "id * 2 AS w"), ("k",), small=False)
    joined = attach(facts, table, tally)
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 30_000 and joined.where("w <> 2 * k").isEmpty()


@pytest.fixture(scope="module")
def events(spark, small):
    """A third of all views are of one ad."""
    rows = event_table(spark, f"{small}/events.parquet").select("ad_id", "event_type", "event_time")
    hot = F.when(F.second("event_time") % 3 == 0, F.lit(42)).otherwise(F.col("ad_id"))
    return rows.withColumn("ad_id", hot).cache()


def replay(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_bounded_counts_with_a_large_table(spark, events, tmp_path):
    campaigns, folder = large(numbered_campaigns(spark)), str(tmp_path / "in")
    store = WindowStore(spark, str(tmp_path / "store"), LongType(), totals=True)
    events.where("day(event_time) <= 15").repartition(2).write.parquet(folder)
    start_bounded_counts(replay(spark, folder), campaigns, store, "40 days", "1 hour", trigger_millis=None).awaitTermination()
    _, tally = TallyFile(spark, f"{store.folder}/hot-keys").load()
    hot = spark.range(1).select(F.xxhash64(F.lit(42).cast("long"))).first()[0]
    assert hot in tally.hot(HOT_PART) and 0 < tally.total <= events.where("event_type = 'view'").count()
    events.where("day(event_time) > 15").repartition(2).write.mode("append").parquet(folder)
    start_bounded_counts(replay(spark, folder), campaigns, store, "40 days", "1 hour", trigger_millis=None).awaitTermination()
    assert differences(store.table(), campaign_windows(events, campaigns, "1 hour")).count() == 0


def test_rows_joined_on_a_stream(spark, events, tmp_path):
    campaigns, folder, out = large(numbered_campaigns(spark)), str(tmp_path / "in"), str(tmp_path / "out")
    views = events.where("event_type = 'view'")
    views.repartition(3).write.parquet(folder)
    for _ in range(2):  # the second start finds nothing new
        start_attached(replay(spark, folder), campaigns, out, trigger_millis=None).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").select("ad_id", "event_time", "campaign_id").collect()
    assert sorted(got) == sorted(attach(views, campaigns).select("ad_id", "event_time", "campaign_id").collect()) != []
    batch, tally = TallyFile(spark, f"{out}/hot-keys").load()
    assert batch == 2 and tally.total == views.count()
