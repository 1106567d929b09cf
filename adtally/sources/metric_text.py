"""Metric vectors: two text files with one number per line, paired by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.operators.numbering import index_slots, pair_by_position, with_row_index
from adtally.session import materialize

# Names of the two vectors' files.
SEEN_FILE = "seen.txt"
UPDATED_FILE = "updated.txt"


def write_metric_vectors(
    frame: DataFrame, folder: str, seen: str, updated: str, order_by: Sequence[str]
) -> None:
    """Write both vectors in the given order, numbered once so that lines stay pairs.

    A NULL is written as ``nan``, to keep its line.
    """
    numbered = with_row_index(frame.select(*dict.fromkeys([*order_by, seen, updated])), order_by)
    ordered = materialize(numbered, "metric-pairs").orderBy("idx")
    for column, name in ((seen, SEEN_FILE), (updated, UPDATED_FILE)):
        ordered.select(F.coalesce(F.col(column).cast("string"), F.lit("nan"))).write.text(f"{folder}/{name}")


def read_metric_vector(spark: SparkSession, path: str) -> DataFrame:
    """``idx, value`` of a text file, or of a folder of parts in name order.

    Blank lines and ``#`` lines do not count, ``nan`` is NULL; anything else
    that is not a number is an error. Each task numbers the lines of the file blocks it
    reads; how the file was cut is written down with the lines, so that later
    reads cannot cut it differently.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.trim("value").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
    )
    tagged = lines.select(
        F.when(F.lower("line") != "nan", F.col("line").cast("double")).alias("value"), "_file", "_block", F.monotonically_increasing_id().alias("_row")
    )
    return index_slots(materialize(tagged, "metric-lines"), ["_file", "_block"], "_row").select("idx", "value")


def read_metric_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``idx, countOfEvent, latencyTime`` of a folder with both vectors."""
    seen = read_metric_vector(spark, f"{folder}/{SEEN_FILE}").withColumnRenamed("value", "countOfEvent")
    updated = read_metric_vector(spark, f"{folder}/{UPDATED_FILE}").withColumnRenamed("value", "latencyTime")
    return pair_by_position(seen, updated)
