"""Does the streamed table say what a recount of all events says?

A day's fingerprint is a sum over its views of a hash of campaign and window, so it can be
added up from events in one pass, without a count per window, and from the table by weighing each
window's hash with its count. Only days whose fingerprints differ are recounted window by window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.functions.columns import tumbling_start
from adtally.operators.campaign_windows import WINDOW, count_views, matched_views
from adtally.operators.events import views_of
from adtally.operators.lookup import Lookup

_KEY = ["campaign_id", "window_start"]

#: A hash is kept in parts, so that sums over 2 ** 42 views of a day fit a long.
_PART_BITS, _PARTS = 21, 3
MARKS = tuple(f"mark{i}" for i in range(_PARTS))
#: What is known of a day without its windows.
DAY_MARKS = ("windows", "views", *MARKS)


def _marks(times: Column) -> list[Column]:
    key = F.xxhash64(*_KEY)
    parts = [F.shiftrightunsigned(key, i * _PART_BITS).bitwiseAND(F.lit((1 << _PART_BITS) - 1)) for i in range(_PARTS)]
    return [F.sum(part * times).alias(name) for name, part in zip(MARKS, parts)]


def day_marks(windows: DataFrame) -> DataFrame:
    """``day, windows, views`` and the fingerprint, of a table with one row per campaign and window."""
    by_day = windows.groupBy(F.to_date("window_start").alias("day"))
    return by_day.agg(F.count(F.lit(1)).alias("windows"), F.sum("seen_count").alias("views"), *_marks(F.col("seen_count")))


def event_day_marks(events: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """``day, views`` and the fingerprint, straight from events: one pass, and one row per day and task to shuffle."""
    matched = matched_views(views_of(events), campaigns, window)
    return matched.groupBy(F.to_date("window_start").alias("day")).agg(F.sum("seen_count").alias("views"), *_marks(F.col("seen_count")))


def parity_by_day(marks: DataFrame, events: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """``day, streamed_views, recounted_views, same``. ``marks`` are the store's (``WindowStore.day_marks``)."""
    streamed = marks.select("day", F.col("views").alias("streamed_views"), F.struct("views", *MARKS).alias("_streamed"), "windows")
    recounted = event_day_marks(events, campaigns, window)
    recounted = recounted.select("day", F.col("views").alias("recounted_views"), F.struct("views", *MARKS).alias("_recounted"))
    both = streamed.join(recounted, "day", "full_outer")
    return both.select(
        "day", F.coalesce("streamed_views", F.lit(0)).alias("streamed_views"), F.coalesce("recounted_views", F.lit(0)).alias("recounted_views"),
        F.col("_streamed").eqNullSafe(F.col("_recounted")).alias("same"), F.coalesce("windows", F.lit(0)).alias("windows"),
    )


def _side_by_side(streamed: DataFrame, recounted: DataFrame) -> DataFrame:
    """Both counts per key. Each side is already partitioned by the key, so nothing moves again."""
    return streamed.select(*_KEY, F.col("seen_count").alias("streamed")).join(
        recounted.select(*_KEY, F.col("seen_count").alias("recounted")), _KEY, "full_outer"
    )


def differences(streamed: DataFrame, recounted: DataFrame) -> DataFrame:
    """Keys whose counts differ, or that one side lacks (NULL). None means complete."""
    return _side_by_side(streamed, recounted).where(~F.col("streamed").eqNullSafe(F.col("recounted")))


def completeness(streamed: DataFrame, recounted: DataFrame) -> DataFrame:
    """One row: how many keys there are, how many differ, and views on both sides."""
    return _side_by_side(streamed, recounted).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(~F.col("streamed").eqNullSafe(F.col("recounted"))).alias("differing"),
        F.coalesce(F.sum("streamed"), F.lit(0)).alias("streamed_views"),
        F.coalesce(F.sum("recounted"), F.lit(0)).alias("recounted_views"),
    )


def _in_days(events: DataFrame, days: Sequence[date], window: str) -> DataFrame:
    """Events whose windows start on one of ``days``; the range of times reaches the scan."""
    ends = F.lit(max(days)).cast("timestamp") + F.expr("INTERVAL 1 DAY") + F.expr(f"INTERVAL {window}")
    near = (F.col("event_time") >= F.lit(min(days)).cast("timestamp")) & (F.col("event_time") < ends)
    return events.where(near).where(F.to_date(tumbling_start("event_time", window)).isin(list(days)))


def store_differences(store, events: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """:func:`differences` of a store, recounting only days whose fingerprints differ."""
    days = parity_by_day(store.day_marks(), events, campaigns, window).where(~F.col("same"))
    return _differences_of(store, events, campaigns, window, [row["day"] for row in days.select("day").collect()])


def _differences_of(store, events: DataFrame, campaigns: Lookup, window: str, days: list[date]) -> DataFrame:
    streamed = store.table()
    if not days:
        return differences(streamed.limit(0), streamed.limit(0))
    recounted = count_views(views_of(_in_days(events, days, window)), campaigns, window)
    return differences(streamed.where(F.to_date("window_start").isin(days)), recounted)


def store_completeness(store, events: DataFrame, campaigns: Lookup, window: str = WINDOW) -> DataFrame:
    """:func:`completeness` of a store. With no day that differs, no window is read or counted."""
    # One row per day.
    days = parity_by_day(store.day_marks(), events, campaigns, window).collect()
    odd = [row["day"] for row in days if not row["same"]]
    sums = {name: sum(row[name] for row in days) for name in ("windows", "streamed_views", "recounted_views")}
    found = _differences_of(store, events, campaigns, window, odd) if odd else None
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("streamed").isNull()).alias("missing")).first() if odd else None
    differing, missing = (counts["n"], counts["missing"]) if counts else (0, 0)
    row = (sums["windows"] + missing, differing, sums["streamed_views"], sums["recounted_views"])
    return store.spark.createDataFrame([row], "windows long, differing long, streamed_views long, recounted_views long")
