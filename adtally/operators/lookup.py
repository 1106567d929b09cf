"""Equi-join of a large table to a keyed table whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.operators.hot_keys import KeyTally
from adtally.session import materialize

#: Largest lookup table that is broadcast: raw bytes plus an allowance per row.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_ALLOWANCE = 64

#: Shares a hot key is spread over, and the part of all facts that makes a key hot.
SALTS = 32
HOT_PART = 0.01

#: What a number that is NULL becomes inside a join; no key may have it.
NO_NUMBER = -(1 << 63)


@dataclass(frozen=True)
class Lookup:
    """A table with one row per key, and whether it is known to fit a broadcast."""

    frame: DataFrame
    keys: tuple[str, ...]
    small: bool

    @classmethod
    def measured(cls, frame: DataFrame, keys: Sequence[str], max_bytes: int = BROADCAST_BYTES) -> Lookup:
        """Add up the size of a stored table with one distributed aggregate.

        A key that comes twice is an error: every fact would be joined twice.
        """
        row_bytes = F.octet_length(F.to_json(F.struct(*frame.columns)))
        size = frame.agg(
            F.sum(F.lit(ROW_ALLOWANCE) + row_bytes).alias("size"),
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct(F.struct(*keys)).alias("keys"),
        ).first()
        if size["rows"] != size["keys"]:
            raise ValueError(f"{size['rows']} rows have only {size['keys']} different keys ({', '.join(keys)})")
        return cls(frame, tuple(keys), (size["size"] or 0) <= max_bytes)

    @classmethod
    def bounded(cls, frame: DataFrame, keys: Sequence[str], rows: int, row_bytes: int) -> Lookup:
        """For a table whose size follows from how it was made."""
        return cls(frame, tuple(keys), rows * (row_bytes + ROW_ALLOWANCE) <= BROADCAST_BYTES)


def attach(facts: DataFrame, table: Lookup, tally: KeyTally | None = None) -> DataFrame:
    """Inner join of ``facts`` to ``table``; rows without a match drop out.

    A small table is broadcast, so ``facts`` does not move. A large one is
    joined by shuffle, with keys that have over ``HOT_PART`` of all facts, of which there are few,
    put in ``SALTS`` shares: by a hash of the whole row, so that a retried task gives the same
    one, and only their rows of the table are copied to every share. Which keys these are is
    counted first, or known from a ``tally`` of facts seen before. A stream cannot be counted: it
    goes by its tally, and without one no key is salted.
    """
    keys = list(table.keys)
    if table.small:
        left, right, on = _keyed(facts, table.frame, keys)
        return left.join(F.broadcast(right), on, "inner").drop(*on)
    if tally is None and facts.isStreaming:
        tally = KeyTally()
    hot = _counted_hot(facts, keys) if tally is None else tally.hot(HOT_PART)
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    share = F.when(is_hot, F.xxhash64(*facts.columns).bitwiseAND(SALTS - 1)).otherwise(F.lit(0).cast("bigint"))
    shares = F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    copied = table.frame.withColumn("_salt", F.explode(shares))
    left, right, on = _keyed(facts.withColumn("_salt", share), copied, keys)
    return left.join(right.hint("merge"), [*on, "_salt"], "inner").drop(*on, "_salt")


def _counted_hot(facts: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of at most 1 / ``HOT_PART`` keys."""
    counted = facts.groupBy(F.xxhash64(*keys).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "key-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [row["key"] for row in counted.where(F.col("n") > HOT_PART * total).collect()]


def _keyed(facts: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with join columns that are never NULL where keys are whole numbers.

    An inner join filters its facts on keys that may be NULL, below the place where
    they are computed, and so would have them computed twice.
    """
    kinds = dict(facts.dtypes)
    names = [f"_key_{key}" for key in keys]

    def never_null(key: str) -> Column:
        return F.coalesce(F.col(key), F.lit(NO_NUMBER)) if kinds[key] == "bigint" else F.col(key)

    left = facts.withColumns({name: never_null(key) for name, key in zip(names, keys)})
    right = table.withColumnsRenamed(dict(zip(keys, names)))
    barred = {name: F.nullif(F.col(name), F.lit(NO_NUMBER)) for name, key in zip(names, keys) if kinds[key] == "bigint"}
    return left, right.withColumns(barred), names


def unmatched(facts: DataFrame, table: Lookup) -> DataFrame:
    """How many fact rows each key without a match has.

    Facts are counted per key before the anti join, so what is joined is one
    row per key however often a key occurs.
    """
    keys = list(table.keys)
    per_key = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    known = table.frame.select(*keys)
    return per_key.join(F.broadcast(known) if table.small else known, keys, "left_anti")
