"""Quantile sketches that add up: counts of values by logarithmic bucket.

A bucket holds the values between two powers of a base close to 1, so a quantile read from the
counts is off by at most ``ACCURACY`` times itself, whatever the values. Sketches of parts are
merged by adding the counts of equal buckets, in any order, and stay as small as the
range of the values: some 230 buckets for each power of ten.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.functions.columns import is_number

#: A quantile's largest error, as a share of itself.
ACCURACY = 0.005
_BASE = (1 + ACCURACY) / (1 - ACCURACY)

_LARGEST = sys.float_info.max

#: Columns of a sketch beside its keys: sign, power of the base, how many values.
SKETCH = "side int, place int, rows long"


def sketch_of(rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """``keys..., side, place, rows``; values that are missing or no number are left out.

    Infinite values have the last place.
    """
    number = F.col(y).cast("double")
    power = F.ceil(F.log(F.abs(number)) / F.lit(math.log(_BASE)))
    place = F.when(F.abs(number) == float("inf"), F.lit(1 << 30)).when(number == 0, F.lit(0)).otherwise(power)
    bucketed = rows.where(is_number(number)).select(*keys, F.signum(number).cast("int").alias("side"), place.cast("int").alias("place"))
    return bucketed.groupBy(*keys, "side", "place").agg(F.count(F.lit(1)).alias("rows"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per ``keys`` from any number of them."""
    return sketches.groupBy(*keys, "side", "place").agg(F.sum("rows").alias("rows"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys..., rows, quantiles``: the values at ranks ``floor(p * (n - 1))``, one per probability.

    ``sketches`` may hold several per key; what is ordered is one row per bucket.
    """
    merged = merge_sketches(sketches, keys)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ordered = group.orderBy("side", F.col("side") * F.col("place"))
    ranked = merged.withColumns({"_past": F.sum("rows").over(ordered), "_n": F.sum("rows").over(group)})
    wanted = [F.floor(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs]
    found = [F.min(F.when(F.col("_past") > rank, F.struct("_past", _value().alias("value")))) for rank in wanted]
    out = ranked.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[x.alias(f"_q{i}") for i, x in enumerate(found)])
    return out.select(*keys, "rows", F.array(*[F.col(f"_q{i}.value") for i in range(len(probs))]).alias("quantiles"))


def _value() -> Column:
    """The middle of a bucket, in proportion."""
    middle = F.least(F.pow(F.lit(_BASE), F.col("place") - 1.0) * F.lit(2 * _BASE / (_BASE + 1)), F.lit(_LARGEST))
    return F.when(F.col("side") == 0, 0.0).when(F.col("place") == 1 << 30, F.col("side") * F.lit(float("inf"))).otherwise(F.col("side") * middle)
