"""Which keys are hot, kept from batch to batch in bounded space.

A batch's heaviest keys are a by-product of the job that reads it: an observed frequent-items
sketch, merged in the engine from the tasks' own, so no key is counted beforehand and nothing is
shuffled for it. A tally adds the batches up. It holds at most ``size`` keys (Misra and Gries): when
there are more, the first count that does not fit is taken off all of them. A key with over
``total / size`` of all rows seen is therefore always held.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Keys a tally holds: ten for each that can have a hundredth of all rows.
SIZE = 1_000
#: Keys asked of a batch, and counters its sketch may use.
_BATCH_KEYS, _BATCH_COUNTERS = 200, 8_192

#: Name of the metrics in a stream's progress.
METRICS = "hot_keys"


def watched(facts: DataFrame, keys: Sequence[str], into: Observation | str = METRICS) -> DataFrame:
    """The same rows; reading them leaves their heaviest keys, by hash, in ``into``."""
    key = F.xxhash64(*keys).alias("_hash")
    marked = facts.withColumn("_hash", key)
    top = F.expr(f"approx_top_k(_hash, {_BATCH_KEYS}, {_BATCH_COUNTERS})")
    return marked.observe(into, top.alias("top"), F.count(F.lit(1)).alias("rows")).drop("_hash")


@dataclass
class KeyTally:
    """Counts of the heaviest keys, by hash."""

    size: int = SIZE
    total: int = 0
    #: What a key's count may lack.
    error: int = 0
    counts: dict[int, int] = field(default_factory=dict)

    def add(self, metrics: Mapping[str, Any]) -> None:
        """Merge what a batch's :func:`watched` rows left."""
        self.merge({item["item"]: item["count"] for item in metrics["top"] or []}, metrics["rows"])

    def merge(self, counts: Mapping[int, int], total: int, error: int = 0) -> None:
        self.total += total
        self.error += error
        for key, n in counts.items():
            self.counts[key] = self.counts.get(key, 0) + n
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.error += cut
            self.counts = {key: n - cut for key, n in self.counts.items() if n > cut}

    def hot(self, part: float) -> list[int]:
        """Keys that may have over ``part`` of all rows seen."""
        return sorted(key for key, n in self.counts.items() if n + self.error > part * self.total)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> KeyTally:
        held = json.loads(text)
        return cls(**{**held, "counts": {int(key): n for key, n in held["counts"].items()}})
