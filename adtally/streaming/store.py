"""The window result table a running job keeps up to date.

Each micro-batch writes its rows to a folder named after its batch id and then notes when it had
written them, so a batch done again counts once. The table is the merge of all noted batches.
Merging is additive, so rows may arrive in any order and any time late. :meth:`WindowStore.fold`
merges finished batches into a table kept by day, of which only the days they touch are rewritten.

What the table is made of stands in a manifest: one small file, replaced as a whole. It names each
day's files, with the day's counts, fingerprint and latency sketch, the last folded batch, and the
day before which the table is closed. Files that neither the manifest nor the one before it names are
deleted by the fold, so what a reader lists depends on the days kept and not on the folds gone by.
"""

from __future__ import annotations

import json
import threading
import time
from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from adtally.functions.columns import lag_millis
from adtally.operators.sketches import SKETCH, sketch_of, sketch_quantiles
from adtally.schemas import window_rows
from adtally.streaming.completeness import DAY_MARKS, day_marks
from adtally.streaming.files import Files

#: Refused rows are counted by day for so many days back from the horizon; what is older is one sum.
REFUSED_DAYS = 400
_EARLIER = "earlier"


@dataclass
class Manifest:
    """One state of the folded table."""

    version: int = 0
    upto: int | None = None
    #: For each day: the fold that wrote its files, and its counts and fingerprint.
    days: dict[str, dict[str, int]] = field(default_factory=dict)
    #: The first day that still takes rows; None takes all.
    horizon: str | None = None
    #: For each closed day: how many rows came for it, and their views.
    refused: dict[str, list[int]] = field(default_factory=dict)


class WindowStore:
    """``campaign_id, window_start, seen_count, time_updated`` under one folder.

    ``totals=False``: batches hold parts of a window's count, which add up.
    ``totals=True``: batches hold a window's count so far; the newest counts.
    ``keep_days``: a fold closes days further back than that from the newest one (days ahead of the
    clock do not count). A closed day's windows leave the table, and rows that come for it later
    are refused and counted (:meth:`refused`): they never start a window's count anew.
    """

    def __init__(
        self, spark: SparkSession, folder: str, campaign_type: DataType = StringType(), totals: bool = False,
        keep_days: int | None = None,
    ) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.totals = totals
        self.keep_days = keep_days
        self._rows = window_rows(campaign_type)
        self._files = Files(spark)
        self._folding: threading.Thread | None = None
        self._failed: BaseException | None = None

    @property
    def checkpoint(self) -> str:
        """Kept with the data: batch ids never start over on a store that has some."""
        return f"{self.folder}/checkpoint"

    @property
    def _batches(self) -> str:
        return f"{self.folder}/batches"

    @property
    def _commits(self) -> str:
        return f"{self.folder}/commits"

    @property
    def _manifests(self) -> str:
        return f"{self.folder}/manifests"

    # ------------------------------------------------------------ writing

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Write one micro-batch's rows, unless that batch is noted as written.

        Rows without a ``time_updated`` get the time their batch was written in full. It is
        in the name of an empty file, made after the write and never replaced.
        """
        if batch_id in self._noted():
            return
        if "time_updated" not in rows.columns:
            rows = rows.withColumn("time_updated", F.lit(None).cast("timestamp"))
        rows.select(*self._rows.fieldNames()).write.mode("overwrite").parquet(f"{self._batches}/batch_id={batch_id}")
        self._files.write_new(self._commits, f"{batch_id}-{time.time_ns() // 1000}")

    def _noted(self) -> dict[int, int]:
        """When each batch that is still kept was written, in microseconds."""
        notes = [name.split("-") for name in self._files.names(self._commits) if name[:1].isdigit()]
        return {int(batch): int(micros) for batch, micros in notes}

    # ------------------------------------------------------------ reading

    def table(self) -> DataFrame:
        """One row per campaign and window. Read it once the job has drained."""
        self.settle()
        state = self._state()
        return self._merged(self._all_rows(state))

    def refused(self) -> DataFrame:
        """``day, windows, views``: rows that came for days already closed; NULL: long ago."""
        self.settle()
        state = self._state()
        late = self._unfolded(state).where(~self._open(state)).groupBy("day")
        late = late.agg(F.count(F.lit(1)).alias("windows"), F.sum("seen_count").alias("views"))
        counted = [(None if day == _EARLIER else day, *n) for day, n in state.refused.items()]
        counted = self.spark.createDataFrame(counted, "day string, windows long, views long").withColumn("day", F.to_date("day"))
        return counted.unionByName(late).groupBy("day").agg(F.sum("windows").alias("windows"), F.sum("views").alias("views"))

    def day_marks(self) -> DataFrame:
        """``day, windows, views`` and the fingerprint of each day's counts.

        Days without unfolded rows have theirs in the manifest: no window is read for them.
        """
        self.settle()
        state, fresh = self._state(), self._fresh_days()
        kept = [(date.fromisoformat(day), *(entry[name] for name in DAY_MARKS)) for day, entry in state.days.items() if day not in fresh]
        marks = self.spark.createDataFrame(kept, f"day date, {', '.join(f'{name} long' for name in DAY_MARKS)}")
        return marks.unionByName(day_marks(self._of_days(state, fresh))) if fresh else marks

    def latency_sketch(self) -> DataFrame:
        """``day, side, place, rows``: how long windows took to settle, as a sketch per day that adds up.

        Days without unfolded rows are read from the sketches their fold left.
        """
        self.settle()
        state, fresh = self._state(), self._fresh_days()
        paths = [self._sketch(state, day) for day in state.days if day not in fresh]
        kept = self._read(paths, f"{SKETCH}, day date", base=f"{self.folder}/sketches").select("day", "side", "place", "rows")
        return kept.unionByName(_latency_sketch(self._of_days(state, fresh))) if fresh else kept

    def latency_quantiles(self, probs: list[float], by_day: bool = False) -> DataFrame:
        """``rows, quantiles`` of settled latency in ms over the whole table, or per day, within the sketch's accuracy."""
        keys = ["day"] if by_day else []
        return sketch_quantiles(self.latency_sketch(), keys, probs)

    # ------------------------------------------------------------ folding

    def fold_later(self, upto: int) -> None:
        """Fold beside the running job, unless a fold is still going on."""
        if self._folding is None or not self._folding.is_alive():
            self.settle()
            self._folding = threading.Thread(target=self._fold_apart, args=(upto,), name="fold", daemon=True)
            self._folding.start()

    def _fold_apart(self, upto: int) -> None:
        try:
            self.fold(upto)
        except BaseException as error:  # told by settle()
            self._failed = error

    def settle(self) -> None:
        """Wait for a fold that goes on; its error, if it had one, is raised here."""
        if self._folding is not None and self._folding is not threading.current_thread():
            self._folding.join()
            self._folding = None
        failed, self._failed = self._failed, None
        if failed is not None:
            raise failed

    def fold(self, upto: int) -> None:
        """Merge all noted batches with ids up to ``upto`` into the table kept by day.

        Readers go over to it with the manifest, after all is written. Files of the state before
        stay until the next fold, so readers of that state have a whole fold's time.
        """
        state = self._state()
        if state.upto is not None and state.upto >= upto:
            return
        fresh = self._unfolded(state, upto)
        # A fold's batches touch few days.
        found = fresh.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("seen_count").alias("views")).collect()
        came = {str(row["day"]): [row["n"], row["views"]] for row in found}
        late = {day: n for day, n in came.items() if state.horizon is not None and day < state.horizon}
        horizon = self._horizon(state, {*state.days, *came} - {*late})
        touched = sorted(day for day in came if horizon is None or day >= horizon)
        days = {day: entry for day, entry in state.days.items() if horizon is None or day >= horizon}
        if touched:
            merged = self._merged(self._of_days_rows(state, touched, upto)).withColumn("day", F.to_date("window_start"))
            path = f"{self.folder}/folded/upto={upto}"
            merged.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
            written = self._read([f"{path}/day={day}" for day in touched], self._rows)
            marks = day_marks(written).collect()  # one row per day touched
            _latency_sketch(written).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(
                f"{self.folder}/sketches/upto={upto}"
            )
            days |= {str(row["day"]): {"fold": upto, **{name: row[name] for name in DAY_MARKS}} for row in marks}
        refused = {day: [n + m for n, m in zip(state.refused.get(day, [0, 0]), late.get(day, [0, 0]))] for day in {*state.refused, *late}}
        now = Manifest(state.version + 1, upto, dict(sorted(days.items())), horizon, _shortened(refused, horizon))
        if not self._files.write_new(self._manifests, f"{now.version:012d}.json", json.dumps(asdict(now))):
            raise RuntimeError(f"another job folds {self.folder}")
        self._forget(state, now)

    def _horizon(self, state: Manifest, days: set[str]) -> str | None:
        """The first day that stays open; it never goes back."""
        ahead = str(date.today() + timedelta(days=1))
        newest = max((day for day in days if day <= ahead), default=None)
        if self.keep_days is None or newest is None:
            return state.horizon
        first = str(date.fromisoformat(newest) - timedelta(days=self.keep_days))
        return max(first, state.horizon or first)

    def _forget(self, before: Manifest, now: Manifest) -> None:
        """Delete what only older states name: batches, notes, day folders, manifests."""
        files = self._files
        if before.upto is not None:
            for name in files.names(self._batches):
                if name.startswith("batch_id=") and int(name.split("=")[1]) <= before.upto:
                    files.delete(f"{self._batches}/{name}")
            for name in files.names(self._commits):
                if name[:1].isdigit() and int(name.split("-")[0]) <= before.upto:
                    files.delete(f"{self._commits}/{name}")
        wanted = {(entry["fold"], day) for state in (before, now) for day, entry in state.days.items()}
        folds = {fold for fold, _ in wanted}
        for parent in (f"{self.folder}/folded", f"{self.folder}/sketches"):
            for version in files.names(parent):
                fold = int(version.split("=")[1])
                if fold not in folds:
                    files.delete(f"{parent}/{version}")
                    continue
                for name in files.names(f"{parent}/{version}"):
                    if name.startswith("day=") and (fold, name[4:]) not in wanted:
                        files.delete(f"{parent}/{version}/{name}")
        for name in files.names(self._manifests):
            if name[:1].isdigit() and int(name.split(".")[0]) < before.version:
                files.delete(f"{self._manifests}/{name}")

    # ------------------------------------------------------------ what a state holds

    def _state(self) -> Manifest:
        names = sorted(name for name in self._files.names(self._manifests) if name[:1].isdigit())
        return Manifest(**json.loads(self._files.read(f"{self._manifests}/{names[-1]}"))) if names else Manifest()

    def _folded(self, state: Manifest, day: str) -> str:
        return f"{self.folder}/folded/upto={state.days[day]['fold']}/day={day}"

    def _sketch(self, state: Manifest, day: str) -> str:
        return f"{self.folder}/sketches/upto={state.days[day]['fold']}/day={day}"

    def _unfolded(self, state: Manifest, upto: int | None = None) -> DataFrame:
        """Rows of noted batches that are not folded, with ``batch_id`` and ``day``.

        As many batches as lie between two folds; one note for each.
        """
        noted = {b: t for b, t in self._noted().items() if (state.upto is None or b > state.upto) and (upto is None or b <= upto)}
        schema = StructType([*self._rows.fields, StructField("batch_id", LongType())])
        rows = self._read([f"{self._batches}/batch_id={b}" for b in sorted(noted)], schema, base=self._batches)
        if noted:
            written = F.create_map(*[F.lit(x).cast("long") for pair in sorted(noted.items()) for x in pair])
            rows = rows.withColumn("time_updated", F.coalesce("time_updated", F.timestamp_micros(written[F.col("batch_id")])))
        return rows.withColumn("day", F.to_date("window_start"))

    @staticmethod
    def _open(state: Manifest):
        return F.lit(True) if state.horizon is None else F.col("day") >= F.lit(state.horizon).cast("date")

    def _all_rows(self, state: Manifest) -> DataFrame:
        """What the last fold left, and the batches after it, by batch id."""
        fresh = self._unfolded(state).where(self._open(state)).drop("day")
        return self._kept(state, list(state.days)).unionByName(fresh)

    def _kept(self, state: Manifest, days: list[str]) -> DataFrame:
        folded = self._read([self._folded(state, day) for day in days], self._rows)
        return folded.withColumn("batch_id", F.lit(-1 if state.upto is None else state.upto).cast("long"))

    def _of_days_rows(self, state: Manifest, days: list[str], upto: int | None = None) -> DataFrame:
        fresh = self._unfolded(state, upto).where(F.col("day").isin([date.fromisoformat(day) for day in days])).drop("day")
        return self._kept(state, [day for day in days if day in state.days]).unionByName(fresh)

    def _of_days(self, state: Manifest, days: list[str]) -> DataFrame:
        return self._merged(self._of_days_rows(state, days))

    def _fresh_days(self) -> list[str]:
        """Days with rows that are not folded yet."""
        state = self._state()
        return sorted(str(row["day"]) for row in self._unfolded(state).where(self._open(state)).select("day").distinct().collect())

    def _merged(self, rows: DataFrame) -> DataFrame:
        count = F.max_by("seen_count", "batch_id") if self.totals else F.sum("seen_count")
        return rows.groupBy("campaign_id", "window_start").agg(
            count.alias("seen_count"), F.max("time_updated").alias("time_updated")
        )

    def _read(self, paths: list[str], schema: StructType | str, base: str | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(*paths)


def _latency_sketch(windows: DataFrame) -> DataFrame:
    """``day, side, place, rows`` of how long after their start windows were last updated."""
    timed = windows.select(F.to_date("window_start").alias("day"), lag_millis(F.col("time_updated"), F.col("window_start")).alias("ms"))
    return sketch_of(timed, ["day"], "ms")


def _shortened(refused: dict[str, list[int]], horizon: str | None) -> dict[str, list[int]]:
    """Refused counts by day, with all but the last ``REFUSED_DAYS`` days in one sum."""
    if horizon is None:
        return refused
    first = str(date.fromisoformat(horizon) - timedelta(days=REFUSED_DAYS))
    out: dict[str, list[int]] = {}
    for day, n in sorted(refused.items()):
        key = day if day != _EARLIER and day >= first else _EARLIER
        out[key] = [a + b for a, b in zip(out.get(key, [0, 0]), n)]
    return out
