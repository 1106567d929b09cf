"""The campaign count as a continuous job."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from adtally.operators.campaign_windows import WINDOW, count_views
from adtally.operators.events import views_of
from adtally.operators.hot_keys import METRICS, KeyTally, watched
from adtally.operators.lookup import Lookup, attach
from adtally.settings import TRIGGER_MILLIS
from adtally.streaming.joins import TallyFile
from adtally.streaming.store import WindowStore

#: Micro-batches from one fold of the store to the next.
FOLD_EVERY = 50


def start_campaign_counts(
    events: DataFrame,
    campaigns: Lookup,
    store: WindowStore,
    window: str = WINDOW,
    trigger_millis: int | None = TRIGGER_MILLIS,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Count views per campaign and window, micro-batch by micro-batch.

    No state is kept in the engine: each micro-batch is counted as a batch
    would be and its rows go to ``store``, which adds them up. Events may be
    late by any time. ``trigger_millis=None`` works off what is there and ends.
    ``fold_every`` has the store merge its batches after every so many of them, in a
    thread beside the stream, so that a trigger never waits for it.

    ``time_updated`` is the time a micro-batch's rows have been written.
    """

    def count_batch(views: DataFrame, batch_id: int) -> None:
        store.upsert(count_views(views, campaigns, window), batch_id)
        if batch_id and batch_id % fold_every == 0:
            store.fold_later(batch_id - 1)  # the last one sure not to be repeated

    return _start(views_of(events).writeStream.foreachBatch(count_batch), store, trigger_millis)


def start_bounded_counts(
    events: DataFrame,
    campaigns: Lookup,
    store: WindowStore,
    delay: str,
    window: str = WINDOW,
    trigger_millis: int | None = TRIGGER_MILLIS,
) -> StreamingQuery:
    """The same count kept in the state store, where windows end with the watermark.

    Events later than ``delay`` are left out, which bounds the state. ``store``
    must be one of totals: each update carries a window's count so far. With a campaign table too
    large to broadcast, views are joined by shuffle, and the ads that batches have shown to be
    hot are salted. They are kept with the store and taken up when the job is started: a running plan does not change.
    """
    if not store.totals:
        raise ValueError("updates carry running totals: use WindowStore(..., totals=True)")
    views, held, tally = views_of(events), TallyFile(events.sparkSession, f"{store.folder}/hot-keys"), KeyTally()
    if not campaigns.small:
        _, tally = held.load()
        views = watched(views, campaigns.keys)
    counts = (
        attach(views.withWatermark("event_time", delay), campaigns, tally)
        .groupBy("campaign_id", F.window("event_time", window).alias("_window"))
        .agg(F.count(F.lit(1)).alias("seen_count"))
        .select("campaign_id", F.col("_window.start").alias("window_start"), "seen_count")
    )
    learnt, started = copy.deepcopy(tally), []

    def learn() -> None:
        """Take up what finished batches have shown; progress comes a batch later, the last one's with the next start."""
        for progress in started[0].recentProgress if started else ():
            metrics = progress.observedMetrics.get(METRICS)
            if metrics is not None and progress.batchId > learn.upto:
                learnt.add(metrics)
                held.save(progress.batchId, learnt)
                learn.upto = progress.batchId

    learn.upto = held.load()[0]

    def keep_batch(rows: DataFrame, batch_id: int) -> None:
        # The state has many partitions, an update few rows: gather them into full files.
        store.upsert(rows.hint("rebalance"), batch_id)
        if not campaigns.small:
            learn()

    query = _start(counts.writeStream.outputMode("update").foreachBatch(keep_batch), store, trigger_millis)
    started.append(query)
    return query


def drain(query: StreamingQuery) -> None:
    """Work off everything that has arrived, then stop: only then are counts complete."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _start(writer: DataStreamWriter, store: WindowStore, trigger_millis: int | None) -> StreamingQuery:
    if trigger_millis is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{trigger_millis} milliseconds")
    return writer.option("checkpointLocation", store.checkpoint).start()
