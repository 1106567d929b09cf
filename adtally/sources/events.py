"""Readers of the ad-event topic: a Kafka topic, or files replayed in its place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adtally.operators.events import CORRUPT, parse_json_events, record_schema, type_events, usable_events
from adtally.schemas import AD_EVENT_FIELDS, EVENT_TABLE
from adtally.settings import RunSettings

_ONLY_AD_NUMBER = r'^\{\s*"k"\s*:\s*(-?(?:0|[1-9][0-9]*))\s*\}$'

_LINES = StructType([StructField("value", StringType())])


def kafka_options(settings: RunSettings, max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": settings.bootstrap_servers,
        "subscribe": settings.topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "minPartitions": str(settings.topic_partitions),
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_records(
    spark: SparkSession, settings: RunSettings, max_offsets_per_trigger: int | None = None
) -> DataFrame:
    """Stream of raw JSON records, one ``value`` column. Needs the Kafka connector package."""
    return (
        spark.readStream.format("kafka")
        .options(**kafka_options(settings, max_offsets_per_trigger))
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON records kept one per line, one ``value`` column."""
    return spark.read.schema(_LINES).text(path)


def json_event_files(spark: SparkSession, path: str, fields: Sequence[str] = AD_EVENT_FIELDS) -> DataFrame:
    """Typed events of files with one JSON record per line; unusable records dropped and counted.

    The JSON reader takes half the time of parsing a text column, and converts
    only the fields that are used further on.
    """
    return usable_events(type_events(_json_reader(spark.read, fields).json(path), fields))


def json_event_stream(
    spark: SparkSession,
    path: str,
    fields: Sequence[str] = AD_EVENT_FIELDS,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same files replayed as a stream."""
    reader = _json_reader(_paced(spark.readStream, files_per_trigger), fields)
    return usable_events(type_events(reader.json(path), fields))


def kafka_events(
    spark: SparkSession,
    settings: RunSettings,
    fields: Sequence[str] = AD_EVENT_FIELDS,
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Typed events of the topic as a stream."""
    return parse_json_events(kafka_records(spark, settings, max_offsets_per_trigger), fields)


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """Events kept as a Parquet table, with typed event columns."""
    return typed_events(spark.read.schema(EVENT_TABLE).parquet(path))


def event_table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table replayed as a stream, file by file.

    The trailing ``*`` makes the path a pattern, which a stream accepts whether
    the table is one file or a folder of them.
    """
    return typed_events(_paced(spark.readStream.schema(EVENT_TABLE), files_per_trigger).parquet(f"{path}*"))


def typed_events(table: DataFrame) -> DataFrame:
    """Name the event columns; event time becomes an instant, as watermarks need."""
    return table.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        "user_id",
        "event_type",
        "value",
        ad_id_of(F.col("props")).alias("ad_id"),
        "props",
    )


def ad_id_of(props: Column) -> Column:
    """The ad number an event carries as ``k`` in its JSON properties.

    Properties that are just that number match a pattern, which costs a quarter
    of a JSON parser; any others go to the parser.
    Unreadable ones are NULL.
    """
    alone = F.regexp_extract(props, _ONLY_AD_NUMBER, 1).try_cast("bigint")
    return F.coalesce(alone, F.from_json(props, "k bigint")["k"])


def _json_reader(reader, fields: Sequence[str]):
    return (
        reader.schema(record_schema(fields)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    )


def _paced(reader, files_per_trigger: int | None):
    return reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
