"""Schemas. Nothing is inferred: a header-only file keeps its types."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Fields of one JSON ad event; all arrive as strings, event_time in epoch ms.
AD_EVENT_FIELDS = ("user_id", "page_id", "ad_id", "ad_type", "event_type", "event_time", "ip_address")

# Columns of a run result file, in file order.
RESULT_FILE_COLUMNS = ("", "0", "1", "2", "3", "4")
RESULT_COLUMNS = ("testIndex", "countOfEvent", "latencyTime", "NumberOfNodes", "TestNumber", "System")

_RESULT_TYPES = (LongType(), DoubleType(), DoubleType(), IntegerType(), IntegerType(), StringType())

#: Positional names, as the files carry them; ``_index`` stands for the blank header.
RESULT_FILE = StructType(
    [StructField(name or "_index", dtype) for name, dtype in zip(RESULT_FILE_COLUMNS, _RESULT_TYPES)]
)

#: Replay table of events.
EVENT_TABLE = StructType(
    [
        StructField("event_id", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
        StructField("props", StringType()),
    ]
)


def window_rows(campaign_type: DataType) -> StructType:
    """Rows of the window result table."""
    return StructType(
        [
            StructField("campaign_id", campaign_type),
            StructField("window_start", TimestampType()),
            StructField("seen_count", LongType()),
            StructField("time_updated", TimestampType()),
        ]
    )
