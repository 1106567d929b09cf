"""Every operator as a query over the test tables.

Each takes ``(spark, folder of tables)``. Times come out zone-free and doubles
rounded, so that results can be set beside those of another engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from adtally.operators.campaign_windows import WINDOW, campaign_windows, event_lag, settled_latency
from adtally.operators.comparisons import anova_two_way, tukey_hsd
from adtally.operators.events import REQUIRED, parse_json_events, read_json_events, views_of
from adtally.operators.lookup import Lookup, attach, unmatched
from adtally.operators.numbering import pair_by_position, with_row_index
from adtally.operators.phases import Phase, phase_latency, phase_rates
from adtally.operators.results import (
    filter_by_nodes,
    head_rows,
    label_result_columns,
    tag_run,
    union_runs,
    with_group_label,
    with_latency_seconds,
)
from adtally.operators.summaries import binned_mean, box_stats, describe_by_group, variance_by_group
from adtally.plans.runs import compare_runs, run_results
from adtally.schemas import RESULT_COLUMNS, RESULT_FILE_COLUMNS
from adtally.session import fresh_path, materialize, use_utc
from adtally.settings import LOAD_RATE, REDUCED_LOAD_RATE, RunSettings
from adtally.sources.campaigns import campaign_table, campaigns_of, numbered_campaigns
from adtally.sources.events import event_table, event_table_stream, json_event_files, json_event_stream
from adtally.sources.metric_text import UPDATED_FILE, read_metric_pairs, read_metric_vector, write_metric_vectors
from adtally.sources.results import read_results, read_written_results, write_results
from adtally.streaming.completeness import parity_by_day, store_completeness, store_differences
from adtally.streaming.counts import start_bounded_counts, start_campaign_counts
from adtally.streaming.joins import start_attached
from adtally.streaming.store import WindowStore

HOURLY = "1 hour"

# 5 % critical values of the studentized range for 6 and 4 groups and many residual degrees of freedom.
Q_SIX_GROUPS, Q_FOUR_GROUPS = 4.030, 3.633

#: January 2024, the month of the test events, cut into three load phases.
PHASES = [
    Phase(1, datetime(2024, 1, 1), datetime(2024, 1, 11), LOAD_RATE),
    Phase(2, datetime(2024, 1, 11), datetime(2024, 1, 21), REDUCED_LOAD_RATE),
    Phase(3, datetime(2024, 1, 21), datetime(2024, 1, 31), LOAD_RATE),
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    """Register under ``name``; event times are read and shown in UTC."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return build(spark, folder)

        QUERIES[name] = run
        return build

    return register


# ---------------------------------------------------------------- tables and output


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return event_table(spark, f"{folder}/events.parquet")


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def _windows(spark: SparkSession, folder: str, window: str = WINDOW) -> DataFrame:
    return campaign_windows(_events(spark, folder), numbered_campaigns(spark), window)


def _lags(spark: SparkSession, folder: str, window: str = WINDOW) -> DataFrame:
    return event_lag(_windows(spark, folder, window))


def _plain(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Zone-free times and rounded doubles."""
    shown = []
    for name, dtype in frame.dtypes:
        if dtype == "timestamp":
            shown.append(F.col(f"`{name}`").cast("timestamp_ntz").alias(name))
        elif dtype == "double":
            shown.append(F.round(F.col(f"`{name}`"), digits).alias(name))
        else:
            shown.append(F.col(f"`{name}`"))
    return frame.select(*shown)


def _counts(windows: DataFrame) -> DataFrame:
    return _plain(windows.select("campaign_id", "window_start", "seen_count"))


def _as_json(events: DataFrame) -> DataFrame:
    """The events as the topic carries them: JSON with text fields, time in epoch ms."""
    text = {
        "user_id": F.col("user_id"),
        "page_id": F.col("event_id"),
        "ad_id": F.col("ad_id"),
        "event_type": F.col("event_type"),
        "event_time": F.unix_millis("event_time"),
    }
    return events.select(
        F.to_json(F.struct(*[column.cast("string").alias(name) for name, column in text.items()])).alias("value")
    )


# ---------------------------------------------------------------- sources and sinks


@_query("source_events")
def _source_events(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        "event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "user_id", "event_type", "value", "ad_id",
    )


@_query("source_events_json")
def _source_events_json(spark: SparkSession, folder: str) -> DataFrame:
    """The topic kept as JSON lines, read back."""
    path = fresh_path(spark, "topic")
    _as_json(_events(spark, folder)).write.text(path)
    return _plain(_numbered_ads(json_event_files(spark, path, REQUIRED)))


@_query("source_campaigns")
def _source_campaigns(spark: SparkSession, folder: str) -> DataFrame:
    return campaigns_of(_events(spark, folder))


@_query("scan_result_csv")
def _scan_result_csv(spark: SparkSession, folder: str) -> DataFrame:
    return read_results(spark, _flat_results(spark, folder)).drop("file_path")


def _flat_results(spark: SparkSession, folder: str) -> str:
    path = f"{fresh_path(spark, 'results')}/test_Nodes-2_System-spark_Test-0.csv"
    _numbered_run(spark, folder).select(*RESULT_COLUMNS).toDF(*RESULT_FILE_COLUMNS).write.option("header", True).csv(
        path
    )
    return path


def _numbered_run(spark: SparkSession, folder: str, window: str = WINDOW, test: int = 0) -> DataFrame:
    settings = RunSettings(nodes=2, test=test, system="spark")
    return run_results(_lags(spark, folder, window), "last_event_lag_ms", settings)


@_query("scan_metric_text")
def _scan_metric_text(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "vectors")
    write_metric_vectors(
        _lags(spark, folder), path, "seen_count", "last_event_lag_ms", ["campaign_id", "window_start"]
    )
    return read_metric_vector(spark, f"{path}/{UPDATED_FILE}")


@_query("scan_metric_pairs")
def _scan_metric_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Both vectors, paired by line."""
    path = fresh_path(spark, "vectors")
    write_metric_vectors(
        _lags(spark, folder), path, "seen_count", "last_event_lag_ms", ["campaign_id", "window_start"]
    )
    return read_metric_pairs(spark, path)


@_query("sink_window_upsert")
def _sink_window_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The store after several micro-batches, the first half of them folded."""
    store = _store(spark)
    replay, files = _shuffled_replay(spark, folder)
    events = spark.readStream.schema(_REPLAY_SCHEMA).option("maxFilesPerTrigger", max(1, files // 4)).parquet(replay)
    start_campaign_counts(events, numbered_campaigns(spark), store, trigger_millis=None, fold_every=2).awaitTermination()
    return _counts(store.table())


@_query("extract_stats")
def _extract_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs read back from a store whose rows were last updated by their last event."""
    store = _store(spark)
    store.upsert(_windows(spark, folder).withColumnRenamed("last_event_time", "time_updated"), 0)
    return _plain(settled_latency(store.table()))


@_query("sink_result_csv")
def _sink_result_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs written side by side, read back."""
    path = fresh_path(spark, "runs")
    runs = union_runs(_numbered_run(spark, folder, WINDOW, 0), _numbered_run(spark, folder, HOURLY, 1))
    write_results(runs, path)
    return read_written_results(spark, path).select(*RESULT_COLUMNS)


# ---------------------------------------------------------------- projections and filters


def _numbered_ads(events: DataFrame) -> DataFrame:
    return events.withColumn("ad_id", F.col("ad_id").try_cast("bigint"))


@_query("parse_event_json")
def _parse_event_json(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("user_id", "page_id", "ad_id", "event_type", "event_time")
    return _plain(parse_json_events(_as_json(_events(spark, folder)), fields))


@_query("parse_event_json_rejects")
def _parse_event_json_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Records of error events get a stray brace; how many of each type are unusable."""
    stray = F.when(F.col("value").contains('"event_type":"error"'), F.lit("{")).otherwise(F.lit(""))
    records = _as_json(_events(spark, folder)).select(F.concat(stray, F.col("value")).alias("value"))
    parsed = read_json_events(records, REQUIRED)
    return parsed.groupBy("rejected").agg(F.count(F.lit(1)).alias("records"))


@_query("filter_project_views")
def _filter_project_views(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(views_of(_events(spark, folder)))


@_query("label_result_columns")
def _label_result_columns_csv(spark: SparkSession, folder: str) -> DataFrame:
    return label_result_columns(read_results(spark, _flat_results(spark, folder))).select(*RESULT_COLUMNS)


@_query("tag_run_constants")
def _tag_run_constants(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(tag_run(_lags(spark, folder).drop("last_event_time"), nodes=2, test=0, system="spark"))


def _lines_as_results(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem(spark, folder).select(
        "l_orderkey",
        F.col("l_linenumber").alias("NumberOfNodes"),
        F.col("l_linestatus").alias("System"),
        F.col("l_extendedprice").alias("latencyTime"),
    )


@_query("filter_by_nodes")
def _filter_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return filter_by_nodes(_lines_as_results(spark, folder), 2)


@_query("latency_seconds")
def _latency_seconds(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lags(spark, folder).select("campaign_id", "window_start", F.col("last_event_lag_ms").alias("latencyTime"))
    return _plain(with_latency_seconds(rows).withColumnRenamed("latencyTime(s)", "latency_s"))


@_query("group_label")
def _group_label(spark: SparkSession, folder: str) -> DataFrame:
    return with_group_label(_lines_as_results(spark, folder)).drop("latencyTime")


# ---------------------------------------------------------------- joins


@_query("positional_pair")
def _positional_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals beside the customers of the open orders, a shorter vector."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    seen = orders.select("o_orderkey", F.col("o_totalprice").alias("seen"))
    updated = orders.where(F.col("o_orderstatus") == "O").select("o_orderkey", F.col("o_custkey").alias("updated"))
    return pair_by_position(
        with_row_index(seen, ["o_orderkey"]).select("idx", "seen"),
        with_row_index(updated, ["o_orderkey"]).select("idx", "updated"),
    )


def _view_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return events.where(F.col("event_type") == "view").select("event_id", "ad_id", "event_time")


@_query("join_campaign")
def _join_campaign(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(attach(_view_rows(spark, folder), numbered_campaigns(spark)))


@_query("join_campaign_measured")
def _join_campaign_measured(spark: SparkSession, folder: str) -> DataFrame:
    """The campaign table comes from the events, and its size is measured."""
    campaigns = materialize(campaigns_of(_events(spark, folder)), "campaigns")
    return _plain(attach(_view_rows(spark, folder), campaign_table(campaigns)))


@_query("join_campaign_large_table")
def _join_campaign_large_table(spark: SparkSession, folder: str) -> DataFrame:
    """The way taken when the campaign table is too large to broadcast."""
    return _plain(attach(_view_rows(spark, folder), _too_large(numbered_campaigns(spark))))


def _too_large(table: Lookup) -> Lookup:
    return Lookup(table.frame, table.keys, small=False)


@_query("join_campaign_unknown_ads")
def _join_campaign_unknown_ads(spark: SparkSession, folder: str) -> DataFrame:
    """Views of ads that are missing from a table of the first nine campaigns."""
    return unmatched(_view_rows(spark, folder), numbered_campaigns(spark, campaigns=9))


# ---------------------------------------------------------------- windows and streams


@_query("campaign_window_count")
def _campaign_window_count(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_windows(spark, folder))


@_query("campaign_window_count_hourly")
def _campaign_window_count_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_windows(spark, folder, HOURLY))


@_query("campaign_window_count_large_table")
def _campaign_window_count_large_table(spark: SparkSession, folder: str) -> DataFrame:
    """Counted per ad first, as when the campaign table is too large to broadcast."""
    return _counts(campaign_windows(_events(spark, folder), _too_large(numbered_campaigns(spark)), HOURLY))


@_query("window_latency")
def _window_latency(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_lags(spark, folder).drop("last_event_time"))


def event_windows(events: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """Windows as a store takes them, last updated by their last event."""
    return campaign_windows(events, campaigns, window).withColumnRenamed("last_event_time", "time_updated")


def _store(spark: SparkSession, totals: bool = False) -> WindowStore:
    return WindowStore(spark, fresh_path(spark, "store"), LongType(), totals)


def _streamed(spark: SparkSession, folder: str, campaigns: Lookup, window: str = WINDOW) -> WindowStore:
    store = _store(spark)
    replay, files = _shuffled_replay(spark, folder)
    events = spark.readStream.schema(_REPLAY_SCHEMA).option("maxFilesPerTrigger", max(1, files // 3)).parquet(replay)
    start_campaign_counts(events, campaigns, store, window, trigger_millis=None).awaitTermination()
    return store


_REPLAY_SCHEMA = "ad_id long, event_type string, event_time timestamp"


def _shuffled_replay(spark: SparkSession, folder: str) -> tuple[str, int]:
    """The events dealt out over files regardless of time, so that most come late."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "replay")
    events = _events(spark, folder).select("ad_id", "event_type", "event_time")
    events.repartition(files).write.parquet(path)
    return path, files


@_query("campaign_window_count_stream")
def _campaign_window_count_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(_streamed(spark, folder, numbered_campaigns(spark)).table())


@_query("campaign_window_count_json_stream")
def _campaign_window_count_json_stream(spark: SparkSession, folder: str) -> DataFrame:
    """From JSON records to counts: the job as it runs on the topic."""
    path, store = fresh_path(spark, "topic"), _store(spark)
    _as_json(_events(spark, folder)).write.text(path)
    events = _numbered_ads(json_event_stream(spark, path, REQUIRED))
    start_campaign_counts(events, numbered_campaigns(spark), store, trigger_millis=None).awaitTermination()
    return _counts(store.table())


@_query("window_latency_stream")
def _window_latency_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Latency by the clock: what holds of it whenever the stream runs."""
    began = spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
    settled = settled_latency(_streamed(spark, folder, numbered_campaigns(spark)).table())
    lags = _lags(spark, folder).select("campaign_id", "window_start", "last_event_lag_ms")
    return _plain(
        settled.join(lags, ["campaign_id", "window_start"]).select(
            "campaign_id", "window_start", "seen_count",
            (F.col("latency_ms") >= F.col("last_event_lag_ms")).alias("after_last_event"),
            (F.col("latency_ms") + F.unix_millis("window_start") >= F.lit(began)).alias("after_start"),
        )
    )


@_query("late_merge")
def _late_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Every micro-batch brings events for windows counted before."""
    store = _store(spark)
    replay, files = _shuffled_replay(spark, folder)
    events = spark.readStream.schema(_REPLAY_SCHEMA).option("maxFilesPerTrigger", max(1, files // 4)).parquet(replay)
    start_campaign_counts(events, numbered_campaigns(spark), store, HOURLY, trigger_millis=None).awaitTermination()
    return _counts(store.table())


@_query("late_merge_closed_days")
def _late_merge_closed_days(spark: SparkSession, folder: str) -> DataFrame:
    """With ten days kept, rows that come for the days before are refused and counted."""
    store = WindowStore(spark, fresh_path(spark, "store"), LongType(), keep_days=10)
    windows = event_windows(_events(spark, folder), numbered_campaigns(spark), HOURLY)
    # Every second hour comes first and moves the horizon; the rest comes late.
    for batch in (0, 1):
        store.upsert(windows.where(F.hour("window_start") % 2 == batch), batch)
        store.fold(batch)
    shown = store.table().groupBy(F.to_date("window_start").alias("day")).agg(F.sum("seen_count").alias("views"))
    refused = store.refused().select("day", F.col("views").alias("refused_views"))
    return shown.join(refused, "day", "full_outer").select(F.col("day").cast("string").alias("day"), "views", "refused_views")


@_query("latency_percentiles")
def _latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 99th percentile of latency per day, from the sketches a store keeps."""
    store = _store(spark)
    windows = event_windows(_events(spark, folder), numbered_campaigns(spark), HOURLY)
    for batch in (0, 1):
        store.upsert(windows.where(F.dayofmonth("window_start") % 2 == batch), batch)
    store.fold(0)
    found = store.latency_quantiles([0.5, 0.99], by_day=True)
    return _plain(found.select(F.col("day").cast("string").alias("day"), F.col("rows").alias("windows"), F.col("quantiles")[0].alias("p50_ms"), F.col("quantiles")[1].alias("p99_ms")))


@_query("campaign_window_count_watermark")
def _late_merge_bounded_state(spark: SparkSession, folder: str) -> DataFrame:
    """The watermark mode with a delay no event exceeds."""
    store = _store(spark, totals=True)
    replay, files = _shuffled_replay(spark, folder)
    events = spark.readStream.schema(_REPLAY_SCHEMA).option("maxFilesPerTrigger", max(1, files // 2)).parquet(replay)
    start_bounded_counts(
        events, numbered_campaigns(spark), store, "40 days", HOURLY, trigger_millis=None
    ).awaitTermination()
    return _counts(store.table())


@_query("campaign_window_count_watermark_large_table")
def _bounded_state_large_table(spark: SparkSession, folder: str) -> DataFrame:
    """The watermark mode with a campaign table too large to broadcast; it is stopped and started once."""
    store, campaigns = _store(spark, totals=True), _too_large(numbered_campaigns(spark))
    replay, files = _shuffled_replay(spark, folder)
    events = spark.readStream.schema(_REPLAY_SCHEMA).option("maxFilesPerTrigger", max(1, files // 2)).parquet(replay)
    for _ in range(2):
        start_bounded_counts(events, campaigns, store, "40 days", HOURLY, trigger_millis=None).awaitTermination()
    return _counts(store.table())


@_query("join_campaign_stream")
def _join_campaign_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Views joined as they stream in, with a campaign table too large to broadcast."""
    path, files = fresh_path(spark, "views"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    _view_rows(spark, folder).repartition(files).write.parquet(path)
    views = spark.readStream.schema("event_id long, ad_id long, event_time timestamp")
    views = views.option("maxFilesPerTrigger", max(1, files // 3)).parquet(path)
    joined = fresh_path(spark, "joined")
    start_attached(views, _too_large(numbered_campaigns(spark)), joined, trigger_millis=None).awaitTermination()
    return _plain(spark.read.parquet(f"{joined}/rows").drop("batch_id"))


@_query("stream_batch_parity")
def _stream_batch_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Day by day fingerprints against one pass over the events."""
    store = _streamed(spark, folder, numbered_campaigns(spark))
    return store_completeness(store, _events(spark, folder), numbered_campaigns(spark))


@_query("stream_parity_by_day")
def _stream_parity_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the stream is folded and the events of one day are missing from it."""
    events, campaigns, store = _events(spark, folder), numbered_campaigns(spark), _store(spark)
    kept = event_windows(events.where(F.to_date("event_time") != F.lit("2024-01-10").cast("date")), campaigns)
    for batch in (0, 1):
        store.upsert(kept.where(F.dayofmonth("window_start") % 2 == batch), batch)
    store.fold(0)
    days = parity_by_day(store.day_marks(), events, campaigns)
    return days.drop("windows").withColumn("day", F.col("day").cast("string"))


@_query("stream_batch_differences")
def _stream_batch_differences(spark: SparkSession, folder: str) -> DataFrame:
    """What is found when the stream knew nine campaigns and the recount knows all."""
    store = _streamed(spark, folder, numbered_campaigns(spark, campaigns=9), HOURLY)
    return _plain(store_differences(store, _events(spark, folder), numbered_campaigns(spark), HOURLY))


@_query("load_phase_rate")
def _load_phase_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(phase_rates(_events(spark, folder), PHASES), digits=9)


@_query("load_phase_latency")
def _load_phase_latency(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(phase_latency(_lags(spark, folder, HOURLY), PHASES))


@_query("load_phase_latency_stream")
def _load_phase_latency_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Load phases of a run whose windows are in a store, half of them folded."""
    store = _store(spark)
    windows = event_windows(_events(spark, folder), numbered_campaigns(spark), HOURLY)
    for batch in (0, 1):
        store.upsert(windows.where(F.dayofmonth("window_start") % 2 == batch), batch)
    store.fold(0)
    return _plain(phase_latency(settled_latency(store.table()), PHASES, "latency_ms"))


@_query("load_phase_rate_hours")
def _load_phase_rate_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Each hour of January a phase, and each day one over its hours."""
    start, hour = datetime(2024, 1, 1), timedelta(hours=1)
    hours = [Phase(h, start + h * hour, start + (h + 1) * hour, LOAD_RATE) for h in range(31 * 24)]
    days = [Phase(1000 + d, start + 24 * d * hour, start + 24 * (d + 1) * hour, REDUCED_LOAD_RATE) for d in range(31)]
    return _plain(phase_rates(_events(spark, folder), hours + days), digits=9)


# ---------------------------------------------------------------- summaries and comparisons


def _value_by_type(spark: SparkSession, folder: str) -> tuple[DataFrame, Sequence[str], str]:
    return _events(spark, folder).select("event_type", "value"), ["event_type"], "value"


def _value_by_hot_type(spark: SparkSession, folder: str) -> DataFrame:
    """Views are one group, all else another, and the values of a third are missing."""
    events = _events(spark, folder).select("event_type", "value")
    kind = F.when(F.col("event_type") == "view", "view").otherwise("other")
    kinds = events.select(kind.alias("kind"), "value")
    lost = events.where("event_type = 'error'").select(F.lit("lost").alias("kind"), F.lit(None).cast("double").alias("value"))
    return kinds.union(lost)


@_query("describe_by_group")
def _describe_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(describe_by_group(*_value_by_type(spark, folder)))


@_query("describe_by_group_large_groups")
def _describe_large_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One group holds four fifths of all rows, another has no value at all."""
    return _plain(describe_by_group(_value_by_hot_type(spark, folder), ["kind"], "value"))


@_query("variance_by_group")
def _variance_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(variance_by_group(*_value_by_type(spark, folder)))


@_query("variance_by_group_missing")
def _variance_missing(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(variance_by_group(_value_by_hot_type(spark, folder), ["kind"], "value"))


def _priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem(spark, folder).select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")


@_query("anova_two_way")
def _anova(spark: SparkSession, folder: str) -> DataFrame:
    table = anova_two_way(_priced_lines(spark, folder), "l_returnflag", "l_linestatus", "l_extendedprice")
    return table.select(
        "term", F.round("sum_sq", -2).alias("sum_sq"), "df", F.round("f", 6).alias("f")
    )


@_query("tukey_hsd")
def _tukey(spark: SparkSession, folder: str) -> DataFrame:
    lines = _priced_lines(spark, folder).withColumn("groups", F.concat("l_returnflag", "l_linestatus"))
    return _plain(tukey_hsd(lines, "groups", "l_extendedprice", Q_SIX_GROUPS), digits=5)


@_query("anova_two_way_many_levels")
def _anova_many_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Seven line numbers against three return flags."""
    lines = _lineitem(spark, folder).select("l_linenumber", "l_returnflag", "l_extendedprice")
    table = anova_two_way(lines, "l_linenumber", "l_returnflag", "l_extendedprice")
    return table.select("term", F.round("sum_sq", -2).alias("sum_sq"), "df", F.round("f", 6).alias("f"))


@_query("binned_mean")
def _binned_means(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(binned_mean(_priced_lines(spark, folder), "l_quantity", "l_extendedprice", 5.0), digits=5)


@_query("box_stats")
def _box_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(box_stats(*_value_by_type(spark, folder)))


@_query("box_stats_large_groups")
def _box_large_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(box_stats(_value_by_hot_type(spark, folder), ["kind"], "value"))


# ---------------------------------------------------------------- sorts and unions


@_query("head_rows")
def _head(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return head_rows(orders, ["o_orderkey"])


@_query("union_runs")
def _union_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All events as two runs, the second without a value column."""
    events = _events(spark, folder).select("event_id", "event_type", "value")
    return union_runs(events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0").drop("value"))


@_query("compare_runs")
def _compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Four runs, of two systems on two and four nodes, described side by side."""
    lags = _lags(spark, folder, HOURLY)
    runs = [
        run_results(
            lags.where((F.col("campaign_id") % 2 == even) & (F.expr("campaign_id div 2 % 2") == first)),
            "last_event_lag_ms",
            RunSettings(nodes=nodes, test=0, system=system),
        )
        for even, nodes in ((0, 2), (1, 4))
        for first, system in ((0, "spark"), (1, "spark2"))
    ]
    tables = compare_runs(union_runs(*runs), 5.0, Q_FOUR_GROUPS)
    keys = ["System", "NumberOfNodes"]
    table = tables["describe"].join(tables["variance"], keys).join(tables["box"].select(*keys, "outliers"), keys)
    return _plain(table.drop("variance")).join(table.select(*keys, F.round("variance", -2).alias("variance")), keys)
