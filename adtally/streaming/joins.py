"""Lookups on a stream, with tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQuery

from adtally.operators.hot_keys import KeyTally, watched
from adtally.operators.lookup import Lookup, attach
from adtally.settings import TRIGGER_MILLIS
from adtally.streaming.files import Files


class TallyFile:
    """A key tally that outlives its job: one small file per state, the last of which counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._files, self._folder = Files(spark), folder

    def _states(self) -> list[str]:
        return sorted(name for name in self._files.names(self._folder) if name[:1].isdigit())

    def load(self) -> tuple[int, KeyTally]:
        """The batch the last state was written after (-1: none yet), and the tally."""
        states = self._states()
        if not states:
            return -1, KeyTally()
        return int(states[-1].split(".")[0]), KeyTally.from_json(self._files.read(f"{self._folder}/{states[-1]}"))

    def save(self, batch_id: int, tally: KeyTally) -> None:
        before = self._states()
        if self._files.write_new(self._folder, f"{batch_id:012d}.json", tally.to_json()):
            for name in before:
                self._files.delete(f"{self._folder}/{name}")


def start_attached(
    facts: DataFrame, table: Lookup, folder: str, trigger_millis: int | None = TRIGGER_MILLIS
) -> StreamingQuery:
    """Write a stream's rows with the columns of their key's row in ``table`` below ``folder``/rows.

    A large table is joined by shuffle. The keys whose rows are salted are those the batches so far
    have shown to be hot: a batch is not counted before it is joined, and adds its own
    heaviest keys to the tally when it is written. The salt changes where rows are joined and never what
    comes out, so a repeated batch, which replaces its rows, may salt other keys.
    """
    held = TallyFile(facts.sparkSession, f"{folder}/hot-keys")
    seen, tally = held.load()

    def join_batch(rows: DataFrame, batch_id: int) -> None:
        nonlocal seen
        shown = Observation()
        known = rows if table.small else watched(rows, table.keys, shown)
        attach(known, table, tally).write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")
        if not table.small and batch_id > seen:
            tally.add(shown.get)
            held.save(batch_id, tally)
            seen = batch_id

    writer = facts.writeStream.foreachBatch(join_batch).option("checkpointLocation", f"{folder}/checkpoint")
    timed = {"availableNow": True} if trigger_millis is None else {"processingTime": f"{trigger_millis} milliseconds"}
    return writer.trigger(**timed).start()
