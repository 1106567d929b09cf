"""One measured run from event stream to result rows, and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.operators.campaign_windows import settled_latency
from adtally.operators.comparisons import anova_two_way, tukey_hsd
from adtally.operators.lookup import Lookup
from adtally.operators.results import number_results, tag_run, with_group_label, with_latency_seconds
from adtally.operators.summaries import binned_mean, box_stats, describe_by_group, variance_by_group
from adtally.settings import RunSettings
from adtally.streaming.counts import start_campaign_counts
from adtally.streaming.store import WindowStore


def run_stream(events: DataFrame, campaigns: Lookup, store: WindowStore, settings: RunSettings) -> DataFrame:
    """Work off an event stream and return the run's result rows.

    The stream is drained before the table is read, so no window is partial.
    """
    start_campaign_counts(events, campaigns, store, settings.window, trigger_millis=None).awaitTermination()
    return run_results(settled_latency(store.table()), "latency_ms", settings)


def run_results(windows: DataFrame, latency: str, settings: RunSettings) -> DataFrame:
    """Result rows of a window table, in campaign and window order."""
    pairs = tag_run(
        windows.withColumns({"countOfEvent": F.col("seen_count"), "latencyTime": F.col(latency)}),
        settings.nodes,
        settings.test,
        settings.system,
    )
    return number_results(pairs, ["campaign_id", "window_start"])


def compare_runs(results: DataFrame, bin_width: float, q_critical: float) -> dict[str, DataFrame]:
    """Everything the analysis of one experiment reports, as tables."""
    labelled = with_group_label(with_latency_seconds(results))
    by_nodes = ["System", "NumberOfNodes"]
    return {
        "describe": describe_by_group(labelled, by_nodes, "latencyTime"),
        "variance": variance_by_group(labelled, by_nodes, "latencyTime"),
        "anova": anova_two_way(labelled, "NumberOfNodes", "System", "latencyTime"),
        "tukey": tukey_hsd(labelled, "groups", "latencyTime", q_critical),
        "binned": binned_mean(labelled, "countOfEvent", "latencyTime(s)", bin_width, by_nodes),
        "box": box_stats(labelled, by_nodes, "latencyTime(s)"),
    }
