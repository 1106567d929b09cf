"""Views per campaign and tumbling event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.functions.columns import lag_millis, tumbling_start
from adtally.operators.events import views_of
from adtally.operators.lookup import Lookup, attach
from adtally.settings import WINDOW_SECONDS

WINDOW = f"{WINDOW_SECONDS} seconds"


def campaign_windows(events: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """``campaign_id, window_start, seen_count, last_event_time`` of all events."""
    return count_views(views_of(events), campaigns, window)


def count_views(views: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """Count ``(ad_id, event_time)`` rows by campaign and window.

    With a small campaign table the only shuffle is that of the counts, one row
    per campaign, window and map task. With a large one, views are counted by
    ad and window first: what is shuffled for the join is counts, and an ad with
    a third of the views weighs no more than one row per window.
    """
    timed = views.withColumn("window_start", tumbling_start("event_time", window))
    if campaigns.small:
        return (
            attach(timed, campaigns)
            .groupBy("campaign_id", "window_start")
            .agg(F.count(F.lit(1)).alias("seen_count"), F.max("event_time").alias("last_event_time"))
        )
    return (
        _by_ad(timed, campaigns)
        .groupBy("campaign_id", "window_start")
        .agg(F.sum("ad_count").alias("seen_count"), F.max("ad_time").alias("last_event_time"))
    )


def _by_ad(timed: DataFrame, campaigns: Lookup) -> DataFrame:
    by_ad = timed.groupBy("ad_id", "window_start").agg(
        F.count(F.lit(1)).alias("ad_count"), F.max("event_time").alias("ad_time")
    )
    return by_ad.join(campaigns.frame, list(campaigns.keys), "inner")


def matched_views(views: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """``campaign_id, window_start, seen_count`` rows that add up to the counts, not yet added up.

    One row per view with a small campaign table, one per ad and window with a large one.
    """
    timed = views.withColumn("window_start", tumbling_start("event_time", window))
    if campaigns.small:
        return attach(timed, campaigns).select("campaign_id", "window_start", F.lit(1).cast("long").alias("seen_count"))
    return _by_ad(timed, campaigns).select("campaign_id", "window_start", F.col("ad_count").alias("seen_count"))


def event_lag(windows: DataFrame) -> DataFrame:
    """How long after its start each window saw its last event, window length included.

    The repeatable twin of :func:`settled_latency`, which depends on the clock.
    """
    return windows.withColumn("last_event_lag_ms", lag_millis(F.col("last_event_time"), F.col("window_start")))


def settled_latency(table: DataFrame) -> DataFrame:
    """How long after its start each window row was last updated, keys kept."""
    return table.select(
        "campaign_id",
        "window_start",
        "seen_count",
        lag_millis(F.col("time_updated"), F.col("window_start")).alias("latency_ms"),
    )
