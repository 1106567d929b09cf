"""What both vector searches need: usable rows, classes of equal vectors, and the final ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vector: str, zero_too: bool) -> Column:
    """Not null and of finite numbers only; an all-zero vector counts if ``zero_too``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.lit(True) if zero_too else F.exists(vector, lambda x: x != 0)
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite & some, F.lit(False))


def classes_of_equals(rows: DataFrame, keep: int) -> DataFrame:
    """``vec_id, ids, vector`` per distinct vector: its least id, and its ``keep`` least ids.

    A query for k neighbours can want no more than k + 1 of equal vectors, so nothing is lost.
    The ranking is cut in every task before rows are shuffled: a vector that a third of all
    rows share sends few of them.
    """
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    least = rows.withColumn("_place", place).where(F.col("_place") <= keep)
    ids = F.sort_array(F.collect_set("vec_id"))
    return least.groupBy("vector").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("vec_id"), "ids", "vector")


def best(found: DataFrame, k: int, *also: str) -> DataFrame:
    """``query_id, rank, vec_id, score`` and ``also``: the k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *also)
