"""Parsing, lookup and counting on small cases."""

import json
from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from adtally.operators.campaign_windows import campaign_windows, settled_latency
from adtally.operators.events import REQUIRED, parse_json_events, read_json_events
from adtally.operators.lookup import SALTS, Lookup, attach, unmatched
from adtally.sources.campaigns import campaign_table, numbered_campaigns
from adtally.sources.events import ad_id_of, event_table, json_event_files, json_records

START = 1_700_000_000_000


def record(ad, kind, millis, **more):
    return json.dumps({"ad_id": ad, "event_type": kind, "event_time": str(millis), **more})


def test_parse_drops_and_counts_what_it_cannot_use(spark):
    lines = [
        record("a", "view", START, user_id="u", ip_address="1.2.3.4"),
        record("b", "click", START + 1),
        "{not json",
        "",
        "[1, 2]",
        json.dumps({"ad_id": "a", "event_type": "view"}),
        json.dumps({"ad_id": "a", "event_type": "view", "event_time": "soon"}),
        json.dumps({"event_type": "view", "event_time": str(START)}),
    ]
    records = spark.createDataFrame([(line,) for line in lines], "value string")
    events = parse_json_events(records)
    assert events.columns == ["user_id", "page_id", "ad_id", "ad_type", "event_type", "event_time", "ip_address"]
    rows = {row["ad_id"]: row for row in events.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["user_id"] == "u" and rows["b"]["user_id"] is None
    assert read_json_events(records).where("rejected").count() == 6
    seen = Observation("seen")
    read_json_events(records, REQUIRED).observe(seen, F.count_if("rejected").alias("n")).count()
    assert seen.get["n"] == 6


def test_files_and_records_are_read_alike(spark, tmp_path):
    lines = [record("a", "view", START), record("b", "click", START + 1, user_id="u"), "{not json", "[1, 2]"]
    lines += [json.dumps({"ad_id": "a", "event_type": "view"}), '{"ad_id": 5, "event_type": "view", "event_time": 7}']
    (tmp_path / "part-0.json").write_text("\n".join(lines))
    for fields in (REQUIRED, ("user_id", *REQUIRED)):
        files = json_event_files(spark, str(tmp_path), fields)
        records = parse_json_events(json_records(spark, str(tmp_path)), fields)
        assert files.columns == records.columns == list(fields)
        assert sorted(map(tuple, files.collect()), key=str) == sorted(map(tuple, records.collect()), key=str)
        assert files.count() == 3


def test_counts_by_hand(spark):
    def at(seconds):
        return START + int(seconds * 1000)  # START is a multiple of ten seconds

    lines = [
        record("a1", "view", at(0)),
        record("a1", "view", at(9.999)),
        record("a2", "view", at(5)),
        record("a1", "view", at(10)),
        record("b1", "view", at(0)),
        record("b1", "click", at(0)),
        record("unknown", "view", at(0)),
    ]
    events = parse_json_events(spark.createDataFrame([(line,) for line in lines], "value string"), REQUIRED)
    table = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B")], "ad_id string, campaign_id string")
    for campaigns in (campaign_table(table), Lookup(table, ("ad_id",), small=False)):
        got = campaign_windows(events, campaigns).select(
            "campaign_id", F.unix_millis("window_start"), "seen_count", F.unix_millis("last_event_time")
        )
        assert sorted(map(tuple, got.collect())) == [
            ("A", START, 3, START + 9999),
            ("A", START + 10000, 1, START + 10000),
            ("B", START, 1, START),
        ]


def test_ad_numbers(spark):
    cases = {
        '{"k": 5}': 5, '{"k":0}': 0, ' {"k": 5}': 5, '{"k": -3}': -3, '{"a": {"k": 1}, "k": 2}': 2,
        '{"a": "\\"k\\": 1"}': None, '{"k": 99999999999999999999}': None, '{"k": null}': None, "{": None, "": None, None: None,
        '{"k": 5}\n': 5,
    }
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(cases)], "i int, props string")
    got = {r["i"]: r["ad"] for r in rows.select("i", ad_id_of(F.col("props")).alias("ad")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_ten_seconds_roll_up_to_hours(spark, small):
    events = event_table(spark, f"{small}/events.parquet")
    campaigns = numbered_campaigns(spark)
    fine = campaign_windows(events, campaigns).groupBy(
        "campaign_id", F.date_trunc("hour", "window_start").alias("window_start")
    ).agg(F.sum("seen_count").alias("seen_count"))
    coarse = campaign_windows(events, campaigns, "1 hour").select("campaign_id", "window_start", "seen_count")
    assert fine.exceptAll(coarse).count() == 0 and coarse.exceptAll(fine).count() == 0
    views = events.where("event_type = 'view'").count()
    assert coarse.agg(F.sum("seen_count")).first()[0] == views


def test_latency_is_floored_on_both_ends(spark):
    row = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 5, datetime(2024, 1, 1, 0, 0, 12, 345999))],
        "campaign_id long, window_start timestamp, seen_count long, time_updated timestamp",
    )
    assert settled_latency(row).first()["latency_ms"] == 12345


def test_a_hot_key_is_spread_and_joined_whole(spark):
    facts = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("ad_id"), F.col("id").alias("n")
    )
    table = numbered_campaigns(spark)
    small, large = attach(facts, table), attach(facts, Lookup(table.frame, table.keys, small=False))
    assert small.count() == large.count() == 30_000
    assert small.exceptAll(large).count() == 0
    hot = facts.where("ad_id = 7").select(F.pmod(F.xxhash64("ad_id", "n"), F.lit(SALTS)).alias("s"))
    shares = [row["count"] for row in hot.groupBy("s").count().collect()]
    assert len(shares) == SALTS and max(shares) < 2 * sum(shares) / SALTS


def test_size_check(spark):
    table = numbered_campaigns(spark).frame
    assert Lookup.measured(table, ["ad_id"]).small
    assert not Lookup.measured(table, ["ad_id"], max_bytes=1000).small
    assert not Lookup.bounded(table, ["ad_id"], rows=10**9, row_bytes=16).small
    assert Lookup.measured(table.limit(0), ["ad_id"]).small


def test_unmatched_counts_rows(spark):
    facts = spark.createDataFrame([(1,), (5000,), (5000,), (None,)], "ad_id long")
    table = numbered_campaigns(spark)
    for lookup in (table, Lookup(table.frame, table.keys, small=False)):
        assert sorted(unmatched(facts, lookup).collect(), key=str) == [(5000, 2), (None, 1)]
