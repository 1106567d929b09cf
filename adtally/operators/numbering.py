"""Numbering rows in a global order without passing them through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.session import materialize


def with_row_index(frame: DataFrame, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Add ``idx``: 0, 1, 2, ... in the order given, starting anew for each ``within``.

    Rows are range-partitioned by ``within`` and the order together, so a run
    with a third of all rows is spread over many tasks. A NULL in ``within`` is a
    run of its own; the order should be unique, or equal rows number arbitrarily.
    """
    ordered = frame.orderBy(*within, *order_by)
    tagged = ordered.withColumn("_slot", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    return index_slots(materialize(tagged, "ordered"), ["_slot"], "_row", within)


def index_slots(stored: DataFrame, slots: Sequence[str], row: str, within: Sequence[str] = ()) -> DataFrame:
    """Turn (slot, row number in slot) into one running number, ``idx``.

    ``stored`` must be a written table: it is read twice and the numbers have
    to agree. Only one count per slot goes through the running sum, so that
    table is as long as the input has partitions or file blocks.
    """
    counts = stored.groupBy(*within, *slots).agg(F.count(F.lit(1)).alias("_rows"), F.min(row).alias("_first"))
    earlier = Window.partitionBy(*within).orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    keys = [*within, *slots]
    starts = materialize(starts.withColumnsRenamed({key: f"_start_{key}" for key in keys}), "slot-starts")
    same = [F.col(key).eqNullSafe(F.col(f"_start_{key}")) for key in keys]
    return (
        stored.join(starts, same, "inner")
        .drop(*(f"_start_{key}" for key in keys))
        .withColumn("idx", F.col("_before") + F.col(row) - F.col("_first"))
        .drop(*slots, row, "_before", "_first")
    )


def pair_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put row i of one numbered vector beside row i of the other; the longer one is padded."""
    return left.join(right, "idx", "full_outer")
