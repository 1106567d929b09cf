"""Grouped summaries of one measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.functions.columns import bin_start, is_number
from adtally.operators.lookup import Lookup, attach
from adtally.operators.quantiles import exact_quantiles, profile_groups
from adtally.session import materialize

QUARTILES = (0.25, 0.5, 0.75)

#: Whiskers reach this many interquartile ranges beyond the box.
WHISKER_REACH = 1.5


def _measured(frame: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Keys and measure only; rows without a key drop out, and a measure that is no number is NULL.

    A group whose measures are all missing stays a group, with a count of 0.
    """
    number = F.col(y).cast("double")
    rows = frame.select(*keys, F.when(is_number(number), number).alias(y))
    return rows.dropna(subset=list(keys))


def describe_by_group(
    frame: DataFrame, keys: Sequence[str], y: str, approximate: bool = False
) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation) and max per group.

    ``approximate`` takes the quartiles from a sketch, in the same single pass.
    """
    rows = _measured(frame, keys, y)
    moments = [
        F.count(y).alias("count"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    ]
    if approximate:
        wanted = F.array(*[F.lit(p) for p in QUARTILES])
        described = rows.groupBy(*keys).agg(*moments, F.percentile_approx(y, wanted).alias("quantiles"))
    else:
        profile = profile_groups(rows, keys, y, QUARTILES, moments)
        described = profile.join(exact_quantiles(rows, keys, y, QUARTILES, profile), list(keys), "left")
    return described.select(
        *keys,
        "count",
        "mean",
        "std",
        "min",
        F.col("quantiles")[0].alias("p25"),
        F.col("quantiles")[1].alias("p50"),
        F.col("quantiles")[2].alias("p75"),
        "max",
    )


def variance_by_group(frame: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Sample variance per group; NULL for a group of one."""
    return _measured(frame, keys, y).groupBy(*keys).agg(F.var_samp(y).alias("variance"))


def binned_mean(frame: DataFrame, x: str, y: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of ``y`` per bin of ``x``. Bins without rows have none."""
    return (
        frame.where(is_number(F.col(x).cast("double")) & is_number(F.col(y).cast("double")))
        .groupBy(*keys, bin_start(F.col(x), width).alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("rows"), F.avg(y).alias("mean"))
    )


def box_stats(
    frame: DataFrame, keys: Sequence[str], y: str
) -> DataFrame:
    """Box plot numbers per group: quartiles, whiskers, how many points lie beyond them."""
    rows = _measured(frame, keys, y).where(F.col(y).isNotNull())
    profile = profile_groups(rows, keys, y, QUARTILES)
    quantiles = exact_quantiles(rows, keys, y, QUARTILES, profile)
    q1, median, q3 = (F.col("quantiles")[i] for i in range(3))
    reach = WHISKER_REACH * (q3 - q1)
    fences = quantiles.select(
        *keys, q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        (q1 - reach).alias("_low"), (q3 + reach).alias("_high"),
    )
    inside = F.col(y).between(F.col("_low"), F.col("_high"))
    # The box is the same on every row of a group, so it rides along as part of the key.
    return (
        attach(rows, Lookup.measured(materialize(fences, "fences"), keys))
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(y))).alias("lower_whisker"),
            F.max(F.when(inside, F.col(y))).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )
