"""Exact quantiles per group, with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.operators.lookup import Lookup, attach
from adtally.session import materialize

#: Accuracy asked of the sketch that tells where to look for a quantile. The
#: result is exact whatever it is; a finer sketch leaves fewer rows to sort.
SKETCH_ACCURACY = 20_000

_MARGIN = 2.0 / SKETCH_ACCURACY


def profile_groups(
    rows: DataFrame, keys: Sequence[str], y: str, probs: Sequence[float], measures: Sequence[Column] = ()
) -> DataFrame:
    """First pass, one row per group: row count, brackets around each quantile, further measures.

    ``rows`` has neither NULL keys nor NaN ``y``; NULL ``y`` does not count, and a group
    of nothing else has NULL brackets. The result is written down: the passes
    that follow must all see the same brackets.
    """
    ends = [min(1.0, max(0.0, p + side * _MARGIN)) for p in probs for side in (-1, 1)]
    brackets = F.percentile_approx(y, F.array(*[F.lit(end) for end in ends]), SKETCH_ACCURACY)
    profile = rows.groupBy(*keys).agg(F.count(y).alias("rows"), brackets.alias("brackets"), *measures)
    return materialize(profile, "group-profile")


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], y: str, probs: Sequence[float], profile: DataFrame
) -> DataFrame:
    """``keys..., quantiles`` (an array, one value per probability) of groups with a value.

    Count what lies outside the brackets, keep values inside, look up the wanted ranks.

    The bracket ends cut each group's values into buckets. Rows are counted by
    bucket, and inside a bracket by distinct value too, before anything is
    shuffled. Bucket counts give the exact rank every bucket starts at, and a
    running count inside one bucket finds the value at a rank. Should a rank
    fall outside its bracket, that bucket's values are fetched in a third pass.
    """
    keys, probs = list(keys), list(probs)
    rows = rows.where(F.col(y).isNotNull()).select(*keys, F.col(y).alias("_y"))
    ends = [F.col("brackets")[i].alias(f"_end{i}") for i in range(2 * len(probs))]
    brackets = Lookup.measured(profile.where("rows > 0").select(*keys, *ends), keys)
    counted = (
        attach(rows, brackets)
        .withColumns({"_bucket": _bucket(len(probs)), "_value": F.when(_in_bracket(len(probs)), F.col("_y"))})
        .groupBy(*keys, "_bucket", "_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    counted = materialize(counted, "quantile-counts")
    targets = materialize(_targets(counted, keys, probs), "quantile-targets")
    if targets.where(~F.col("_kept")).limit(1).count():
        hit = targets.groupBy(*keys).agg(F.collect_set("_bucket").alias("_hit"))
        counted = (
            attach(rows, Lookup(brackets.frame.join(hit, keys), brackets.keys, brackets.small))
            .withColumn("_bucket", _bucket(len(probs)))
            .where(F.array_contains("_hit", F.col("_bucket")))
            .groupBy(*keys, "_bucket", F.col("_y").alias("_value"))
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
    found = (
        _running(counted.where(F.col("_value").isNotNull()), keys)
        .join(targets, [*keys, "_bucket"])
        .where((F.col("_at") < F.col("_past")) & (F.col("_at") >= F.col("_past") - F.col("_rows")))
    )
    sides = [
        F.max(F.when((F.col("_probe") == i) & (F.col("_side") == side), F.col("_value"))).alias(f"_{side}{i}")
        for i in range(len(probs))
        for side in ("low", "high")
    ]
    values = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *sides)
    between = [
        # Equal neighbours need no interpolation, and infinite ones allow none.
        F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(
            F.col(f"_low{i}") + (_position(p) - F.floor(_position(p))) * (F.col(f"_high{i}") - F.col(f"_low{i}"))
        )
        for i, p in enumerate(probs)
    ]
    return values.select(*keys, F.array(*between).alias("quantiles"))


def _running(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_past``: the rows of a bucket up to and with each of its values.

    Values are sorted over as many tasks as it takes, each task adds up its own, and
    only one sum per bucket and task is added up further: no bucket is one task's.
    """
    ordered = counted.orderBy(*keys, "_bucket", "_value").withColumn("_slot", F.spark_partition_id())
    ordered = materialize(ordered, "quantile-values")
    sums = ordered.groupBy(*keys, "_bucket", "_slot").agg(F.sum("_rows").alias("_in_slot"))
    earlier = Window.partitionBy(*keys, "_bucket").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_in_slot").over(earlier), F.lit(0))).drop("_in_slot")
    here = Window.partitionBy(*keys, "_bucket", "_slot").orderBy("_value")
    return (
        ordered.withColumn("_here", F.sum("_rows").over(here))
        .join(starts, [*keys, "_bucket", "_slot"])
        .withColumn("_past", F.col("_before") + F.col("_here"))
    )


def _bucket(probes: int) -> Column:
    """Grows with ``_y``, and changes at each bracket end and just past it."""
    ends = [F.col(f"_end{i}") for i in range(2 * probes)]
    return reduce(add, [(F.col("_y") > end).cast("int") + (F.col("_y") >= end).cast("int") for end in ends])


def _in_bracket(probes: int) -> Column:
    return reduce(or_, [F.col("_y").between(F.col(f"_end{2 * i}"), F.col(f"_end{2 * i + 1}")) for i in range(probes)])


def _position(p: float) -> Column:
    """Where a quantile lies among ``_n`` sorted rows counted from 0."""
    return F.lit(float(p)) * (F.col("_n") - 1)


def _targets(counted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The rows on either side of each quantile: bucket, rank in it, and whether its values were kept."""
    buckets = counted.groupBy(*keys, "_bucket").agg(
        F.sum("_rows").alias("_size"), F.max(F.col("_value").isNotNull()).alias("_kept")
    )
    group = Window.partitionBy(*keys)
    ranges = buckets.withColumns(
        {"_past": F.sum("_size").over(group.orderBy("_bucket")), "_n": F.sum("_size").over(group)}
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("probe"), F.lit(side).alias("side"), rounded(_position(p)).alias("row"))
            for i, p in enumerate(probs)
            for side, rounded in (("low", F.floor), ("high", F.ceil))
        ]
    )
    return (
        ranges.withColumn("_wanted", F.explode(wanted))
        .where((F.col("_wanted.row") < F.col("_past")) & (F.col("_wanted.row") >= F.col("_past") - F.col("_size")))
        .select(
            *keys,
            "_bucket",
            "_kept",
            "_n",
            F.col("_wanted.probe").alias("_probe"),
            F.col("_wanted.side").alias("_side"),
            (F.col("_wanted.row") - F.col("_past") + F.col("_size")).alias("_at"),
        )
    )
