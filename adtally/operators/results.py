"""Shaping run result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.functions.columns import group_label, latency_seconds
from adtally.operators.numbering import with_row_index
from adtally.schemas import RESULT_COLUMNS, RESULT_FILE


def label_result_columns(rows: DataFrame) -> DataFrame:
    """Give the six positional columns their names."""
    return rows.withColumnsRenamed(dict(zip(RESULT_FILE.fieldNames(), RESULT_COLUMNS)))


def tag_run(rows: DataFrame, nodes: int, test: int, system: str) -> DataFrame:
    """Append what identifies the run."""
    return rows.withColumns(
        {
            "NumberOfNodes": F.lit(nodes).cast("int"),
            "TestNumber": F.lit(test).cast("int"),
            "System": F.lit(system),
        }
    )


def filter_by_nodes(rows: DataFrame, nodes: int) -> DataFrame:
    return rows.where(F.col("NumberOfNodes") == nodes)


def with_latency_seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("latencyTime(s)", latency_seconds(F.col("latencyTime")))


def with_group_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("groups", group_label(F.col("NumberOfNodes"), F.col("System")))


def head_rows(rows: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in an explicit order; only ``n`` rows per task are compared."""
    return rows.orderBy(*order_by).limit(n)


def union_runs(*runs: DataFrame) -> DataFrame:
    """All rows of all runs, matched by column name; what a run lacks is NULL."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), runs)


def number_results(pairs: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Result rows from tagged ``countOfEvent, latencyTime`` rows.

    ``testIndex`` counts from 0 in the given order within each run.
    """
    run = ["System", "NumberOfNodes", "TestNumber"]
    return (
        with_row_index(pairs, order_by, within=run)
        .withColumnRenamed("idx", "testIndex")
        .withColumn("countOfEvent", F.col("countOfEvent").cast("double"))
        .withColumn("latencyTime", F.col("latencyTime").cast("double"))
        .select(*RESULT_COLUMNS)
    )
