"""Column expressions. All built-in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis_to_time(millis: Column) -> Column:
    """Epoch milliseconds (number or text) to an instant; NULL if not a number."""
    return F.timestamp_millis(millis.try_cast("bigint"))


def tumbling_start(time: str, length: str) -> Column:
    """Start of the tumbling window ``time`` falls in."""
    return F.window(time, length)["start"]


def lag_millis(until: Column, since: Column) -> Column:
    """Whole milliseconds from ``since`` to ``until``, both floored first."""
    return F.unix_millis(until) - F.unix_millis(since)


def latency_seconds(millis: Column) -> Column:
    return millis / F.lit(1000.0)


def group_label(nodes: Column, system: Column) -> Column:
    """Node count and system run together, such as ``2spark``."""
    return F.concat(nodes.cast("string"), system)


def bin_start(x: Column, width: float) -> Column:
    """Lower edge of the bin of the given width that ``x`` falls in."""
    return F.floor(x / F.lit(float(width))) * F.lit(float(width))


def is_number(value: Column) -> Column:
    """Present and not NaN, the values a summary counts."""
    return value.isNotNull() & ~F.isnan(value)
