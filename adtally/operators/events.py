"""Parsing ad events and keeping the views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adtally.functions.columns import millis_to_time
from adtally.schemas import AD_EVENT_FIELDS
from adtally.settings import VIEW

#: Fields without which an event cannot be counted.
REQUIRED = ("ad_id", "event_type", "event_time")

#: Column that holds a record which is not valid JSON.
CORRUPT = "_corrupt"

#: Name under which record and reject counts are observed.
PARSE_METRICS = "ad_event_parse"


def record_schema(fields: Sequence[str]) -> StructType:
    """Text fields as records carry them, and a place for what cannot be parsed."""
    return StructType([*(StructField(name, StringType()) for name in fields), StructField(CORRUPT, StringType())])


def read_json_events(records: DataFrame, fields: Sequence[str] = AD_EVENT_FIELDS) -> DataFrame:
    """One row per JSON ``value``: the wanted fields, and ``rejected`` if it is unusable.

    Only the wanted fields are converted; ask for ``REQUIRED`` alone when the
    events are just to be counted.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = records.withColumn("_event", F.from_json("value", record_schema(fields), options))
    return type_events(parsed.select("*", "_event.*").drop("value", "_event"), fields)


def type_events(parsed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Turn event time into an instant and mark events that lack what is needed."""
    rejected = F.col(CORRUPT).isNotNull()
    typed = parsed
    if "event_time" in fields:
        typed = typed.withColumn("event_time", millis_to_time(F.col("event_time")))
    for name in REQUIRED:
        if name in fields:
            rejected = rejected | F.col(name).isNull()
    return typed.withColumn("rejected", rejected).drop(CORRUPT)


def usable_events(events: DataFrame) -> DataFrame:
    """Drop the rejected events, and count them as they pass.

    The counts come out with the same job, as the observed metrics named
    ``PARSE_METRICS`` (``records`` and ``rejected``), in batch and streaming.
    """
    return (
        events.observe(
            PARSE_METRICS,
            F.count(F.lit(1)).alias("records"),
            F.count_if("rejected").alias("rejected"),
        )
        .where(~F.col("rejected"))
        .drop("rejected")
    )


def parse_json_events(records: DataFrame, fields: Sequence[str] = AD_EVENT_FIELDS) -> DataFrame:
    """Typed events of raw JSON records; unusable ones are dropped and counted."""
    return usable_events(read_json_events(records, fields))


def views_of(events: DataFrame) -> DataFrame:
    """The views, cut down to what the count needs. The filter reaches the scan."""
    return events.where(F.col("event_type") == VIEW).select("ad_id", "event_time")
