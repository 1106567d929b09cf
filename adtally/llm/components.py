"""Connected components of links by joining component labels, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.session import materialize


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, comp``) with the components merged that ``links`` (``a, b``) join; comp is the least node.

    Each round hangs every component under the least one it is linked to, follows those
    pointers to their ends and renames. Rounds are few (a logarithm of the longest chain), each
    is written to the shared folder, and nothing but the number of open links comes back.
    """
    while True:
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(
            labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b"
        )
        across = ends.where("ca <> cb").select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low")).distinct()
        links = materialize(across.select(F.col("high").alias("a"), F.col("low").alias("b")), "component-links")
        if links.isEmpty():
            return labels
        parents = materialize(links.groupBy("a").agg(F.min("b").alias("up")), "component-parents")
        while True:
            above = parents.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = parents.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
            jumped = materialize(jumped, "component-parents")
            parents = jumped.select("a", "up")
            if jumped.where("moved").isEmpty():
                break
        renamed = labels.join(parents.select(F.col("a").alias("comp"), "up"), "comp", "left")
        labels = materialize(renamed.select("node", F.coalesce("up", "comp").alias("comp")), "component-labels")
