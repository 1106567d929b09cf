"""Load phases: what rate each stretch of a run really had, and how windows fared in it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.operators.lookup import Lookup, attach
from adtally.settings import RunSettings


class Phase(NamedTuple):
    """A half-open stretch of event time and the events per second meant for it."""

    phase: int
    start: datetime
    end: datetime
    target_rate: float


_PHASE_SCHEMA = "phase int, start timestamp, end timestamp, target_rate double"


def fluctuating_load(start: datetime, settings: RunSettings = RunSettings()) -> list[Phase]:
    """Full, reduced and full load again, for equally long."""
    rates = (settings.load_rate, settings.reduced_load_rate, settings.load_rate)
    length = timedelta(seconds=settings.phase_seconds)
    return [Phase(i + 1, start + i * length, start + (i + 1) * length, rate) for i, rate in enumerate(rates)]


def in_utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment


def phase_table(spark: SparkSession, phases: Sequence[Phase]) -> DataFrame:
    rows = [(p.phase, in_utc(p.start), in_utc(p.end), float(p.target_rate)) for p in phases]
    return spark.createDataFrame(rows, _PHASE_SCHEMA)


class PhaseIndex:
    """Phases as data: the sorted moments at which any of them starts or ends, and what lies between.

    Two neighbouring moments bound a stretch, which is wholly inside or outside of each phase. A
    row's stretch is found among the moments by halving, with as many steps as their number
    has binary digits, so the plan has the same size for three phases and for ten thousand.
    """

    def __init__(self, phases: Sequence[Phase]) -> None:
        if any(p.end <= p.start for p in phases):
            raise ValueError("a phase must end after it starts")
        self.phases = list(phases)
        self._ends = [(_micros(p.start), _micros(p.end)) for p in phases]
        self._cuts = sorted({moment for both in self._ends for moment in both})

    def stretch(self, time: Column) -> Column:
        """The place of the last moment not after ``time``; -1 before all of them."""
        steps = len(self._cuts).bit_length()
        # One constant, padded so that no step reads past its end.
        padded = [*self._cuts, *[_NEVER] * ((1 << steps) - len(self._cuts))]
        cuts = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
        strides = F.array(*[F.lit(1 << step) for step in reversed(range(steps))])
        micros = F.unix_micros(time)
        place = F.aggregate(
            strides, F.lit(0), lambda at, stride: at + F.when(F.get(cuts, at + stride - 1) <= micros, stride).otherwise(F.lit(0))
        )
        return place - 1

    def covered(self, spark: SparkSession) -> Lookup:
        """``_stretch`` with the ``phases`` over it, as an array; stretches outside of all phases are left out."""
        place = {moment: at for at, moment in enumerate(self._cuts)}
        spans = [(p.phase, place[start], place[end] - 1) for p, (start, end) in zip(self.phases, self._ends)]
        each = spark.createDataFrame(spans, "phase int, low int, high int")
        each = each.select(F.explode(F.sequence("low", "high")).alias("_stretch"), "phase")
        # As many entries as phases, times how many of them overlap.
        entries = sum(high - low + 1 for _, low, high in spans)
        grouped = each.groupBy("_stretch").agg(F.collect_list("phase").alias("_phases"))
        return Lookup.bounded(grouped, ["_stretch"], rows=entries, row_bytes=8)


#: Later than any moment.
_NEVER = (1 << 63) - 1


def assign_phase(rows: DataFrame, time: str, phases: Sequence[Phase]) -> DataFrame:
    """Rows with the columns of the phase their ``time`` falls in; others drop out.

    A row in two overlapping phases comes out twice. The rows may be a stream.
    """
    index, spark = PhaseIndex(phases), rows.sparkSession
    inside = rows.withColumn("_stretch", index.stretch(F.col(time))).where(F.col("_stretch") >= 0)
    placed = attach(inside, index.covered(spark)).withColumn("phase", F.explode("_phases")).drop("_stretch", "_phases")
    table = Lookup.bounded(phase_table(spark, phases), ["phase"], rows=len(phases), row_bytes=32)
    return attach(placed, table)


def _micros(moment: datetime) -> int:
    return round((in_utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def _per_phase(rows: DataFrame, time: str, phases: Sequence[Phase], parts: Sequence[Column], whole: Sequence[Column]) -> DataFrame:
    """Aggregates per phase: ``parts`` per stretch before anything is joined, ``whole`` over a phase's stretches."""
    index = PhaseIndex(phases)
    per_stretch = rows.groupBy(index.stretch(F.col(time)).alias("_stretch")).agg(*parts)
    each = attach(per_stretch.where(F.col("_stretch") >= 0), index.covered(rows.sparkSession))
    return each.withColumn("phase", F.explode("_phases")).groupBy("phase").agg(*whole)


def phase_rates(events: DataFrame, phases: Sequence[Phase], time: str = "event_time") -> DataFrame:
    """Events, length, and observed against target rate per phase, empty phases too."""
    counted = _per_phase(
        events.select(time), time, phases, [F.count(F.lit(1)).alias("_n")], [F.sum("_n").alias("_events")]
    )
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    return (
        phase_table(events.sparkSession, phases)
        .join(counted, "phase", "left")
        .select("phase", F.coalesce("_events", F.lit(0)).alias("events"), seconds.alias("seconds"), "target_rate")
        .withColumn("observed_rate", F.col("events") / F.col("seconds"))
        .withColumn("share_of_target", F.col("observed_rate") / F.nullif(F.col("target_rate"), F.lit(0.0)))
    )


def phase_latency(
    windows: DataFrame, phases: Sequence[Phase], latency: str = "last_event_lag_ms"
) -> DataFrame:
    """Windows, views and latency of the windows that start in each phase.

    Of a streamed run: ``phase_latency(settled_latency(store.table()), phases, "latency_ms")``.
    """
    parts = [
        F.count(F.lit(1)).alias("windows"), F.sum("seen_count").alias("views"), F.sum(latency).alias("_sum"),
        F.count(latency).alias("_timed"), F.max(latency).alias("_max"),
    ]
    whole = [
        F.sum("windows").alias("windows"), F.sum("views").alias("views"),
        (F.sum("_sum") / F.nullif(F.sum("_timed"), F.lit(0))).alias("mean_latency_ms"), F.max("_max").alias("max_latency_ms"),
    ]
    return _per_phase(windows, "window_start", phases, parts, whole)
