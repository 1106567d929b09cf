"""Whether what shares a group hangs together, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.session import materialize


def count_components(members: DataFrame, nodes: int) -> tuple[int, int]:
    """Components of the ``nodes`` different ``node`` values that ``group, node`` rows link, and how many tables that took.

    Each group links its nodes to the least of them. In a round every node goes under its least
    smaller neighbour, pointers are doubled until they end at a root, and links are renamed to
    roots: at least half of the components that still have links vanish. A node that goes
    under another is a component less, so only these are counted and no labels are kept.
    """
    least = members.groupBy("group").agg(F.min("node").alias("low"))
    links = members.join(least, "group").where("node <> low").select(F.col("node").alias("high"), "low").distinct()
    if nodes - links.agg(F.count_distinct("high")).first()[0] <= 1:
        return 1, 0
    links, tables = materialize(links, "links"), 1
    while True:
        roots = materialize(links.groupBy("high").agg(F.min("low").alias("root")), "roots")
        under, tables = roots.count(), tables + 1
        nodes -= under
        if nodes <= 1 or not under:
            return nodes, tables
        while True:
            above = roots.select(F.col("high").alias("root"), F.col("root").alias("top"))
            jumped = roots.join(above, "root", "left")
            jumped = materialize(jumped.select("high", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
            roots, tables = jumped.select("high", "root"), tables + 1
            if jumped.where("moved").isEmpty():
                break
        ends = [F.coalesce("root", name) for name in ("high", "low")]
        for name, end in zip(("high", "low"), ends):
            links = links.join(roots.select(F.col("high").alias(name), "root"), name, "left").withColumn(name, end).drop("root")
        links = links.where("high <> low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low"))
        links, tables = materialize(links.distinct(), "links"), tables + 1


def check_connected(members: DataFrame, nodes: int) -> None:
    """An error if the nodes fall apart into blocks that share no group."""
    if count_components(members, nodes)[0] > 1:
        raise ValueError("the design is not connected")
