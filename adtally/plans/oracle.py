"""The same results in plain SQL, for another engine to check the queries by."""

from __future__ import annotations

from adtally.settings import LOAD_RATE, REDUCED_LOAD_RATE

_EVENTS = """e AS (
    SELECT event_id, ts AS event_time, user_id, event_type, value,
           TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS ad_id
    FROM events)"""

# A numbered ad belongs to campaign ad_id // 10; there are a thousand ads.
_KNOWN = "event_type = 'view' AND ad_id BETWEEN 0 AND 999"

_MILLIS = "epoch_us({0}) // 1000"


def _window_rows(length: str, name: str = "w") -> str:
    return f"""{name} AS (
    SELECT ad_id // 10 AS campaign_id, time_bucket(INTERVAL '{length}', event_time) AS window_start,
           count(*) AS seen_count, max(event_time) AS last_event_time
    FROM e WHERE {_KNOWN} GROUP BY ALL)"""


def _lag(alias: str = "") -> str:
    return f"{_MILLIS.format(alias + 'last_event_time')} - {_MILLIS.format(alias + 'window_start')}"


def _run(name: str, source: str, test: int) -> str:
    return f"""{name} AS (
    SELECT row_number() OVER (ORDER BY campaign_id, window_start) - 1 AS "testIndex",
           CAST(seen_count AS DOUBLE) AS "countOfEvent", CAST({_lag()} AS DOUBLE) AS "latencyTime",
           CAST(2 AS INTEGER) AS "NumberOfNodes", CAST({test} AS INTEGER) AS "TestNumber", 'spark' AS "System"
    FROM {source})"""


_TEN = f"WITH {_EVENTS}, {_window_rows('10 seconds')}"
_HOUR = f"WITH {_EVENTS}, {_window_rows('1 hour')}"
_COUNTS = "SELECT campaign_id, window_start, seen_count FROM w"

_PHASES = f"""phases(phase, start_at, end_at, target_rate) AS (VALUES
    (CAST(1 AS INTEGER), TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-11', CAST({LOAD_RATE} AS DOUBLE)),
    (CAST(2 AS INTEGER), TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-21', CAST({REDUCED_LOAD_RATE} AS DOUBLE)),
    (CAST(3 AS INTEGER), TIMESTAMP '2024-01-21', TIMESTAMP '2024-01-31', CAST({LOAD_RATE} AS DOUBLE)))"""

_DESCRIBE = """SELECT event_type, count(value) AS "count", round(avg(value), 6) AS mean,
           round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
           round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
    FROM events GROUP BY event_type"""

_BOX = """WITH q AS (
    SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
           quantile_cont(value, 0.75) AS q3
    FROM events GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(value) FILTER (value BETWEEN low AND high), 6) AS lower_whisker,
       round(max(value) FILTER (value BETWEEN low AND high), 6) AS upper_whisker,
       count(*) FILTER (value NOT BETWEEN low AND high) AS outliers
FROM events JOIN f USING (event_type) GROUP BY event_type, q1, median, q3"""

# One group of views, one of all else, and one whose values are all missing.
_KINDS = """k AS (
    SELECT CASE WHEN event_type = 'view' THEN 'view' ELSE 'other' END AS kind, value FROM events
    UNION ALL SELECT 'lost', CAST(NULL AS DOUBLE) FROM events WHERE event_type = 'error')"""


def _of_kinds(sql: str) -> str:
    """A summary of events by type, by kind instead."""
    return sql.replace("event_type", "kind").replace("FROM events", "FROM k")


# Type II sums of squares from exact decimal sums, for a second factor of two levels.
_ANOVA = """WITH y AS (
    SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_extendedprice AS DECIMAL(18, 2)) AS y FROM lineitem),
cell AS (SELECT a, b, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s, CAST(sum(y * y) AS DOUBLE) AS ss FROM y GROUP BY a, b),
la AS (SELECT a, sum(n) AS n, sum(s) AS s FROM cell GROUP BY a),
lb AS (SELECT b, sum(n) AS n, sum(s) AS s FROM cell GROUP BY b),
pair AS (
    SELECT a, sum(n) FILTER (b = 'F') AS n1, sum(n) FILTER (b = 'O') AS n2,
           sum(s) FILTER (b = 'O') / sum(n) FILTER (b = 'O')
         - sum(s) FILTER (b = 'F') / sum(n) FILTER (b = 'F') AS d
    FROM cell GROUP BY a),
t AS (
    SELECT (SELECT sum(ss - s * s / n) FROM cell) AS rss,
           (SELECT sum(s * s / n) FROM cell) AS between_cells,
           (SELECT sum(s * s / n) FROM la) AS between_a,
           (SELECT sum(s * s / n) FROM lb) AS between_b,
           (SELECT pow(sum(n1 * n2 / (n1 + n2) * d), 2) / sum(n1 * n2 / (n1 + n2)) FROM pair) AS b_given_a,
           (SELECT CAST(sum(n) AS BIGINT) FROM cell) AS n,
           (SELECT count(*) FROM cell) AS cells,
           (SELECT count(*) FROM la) AS levels_a,
           (SELECT count(*) FROM lb) AS levels_b),
r AS (
    SELECT *, between_cells - between_a - b_given_a AS both_ss,
           n - cells AS df_rest, cells - levels_a - levels_b + 1 AS df_both FROM t)
SELECT 'l_returnflag' AS term, round((between_cells - between_b) - both_ss, -2) AS sum_sq, levels_a - 1 AS df,
       round(((between_cells - between_b) - both_ss) / (levels_a - 1) / (rss / df_rest), 6) AS f FROM r
UNION ALL
SELECT 'l_linestatus', round(b_given_a, -2), levels_b - 1, round(b_given_a / (levels_b - 1) / (rss / df_rest), 6) FROM r
UNION ALL
SELECT 'l_returnflag:l_linestatus', round(both_ss, -2), df_both, round(both_ss / df_both / (rss / df_rest), 6) FROM r
UNION ALL
SELECT 'Residual', round(rss, -2), df_rest, NULL FROM r"""

# The factor of three levels is solved for with the other eliminated; the last level's effect is 0.
_ANOVA_MANY = """WITH y AS (
    SELECT l_linenumber AS a, l_returnflag AS b, CAST(l_extendedprice AS DECIMAL(18, 2)) AS y FROM lineitem),
cell AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s, CAST(sum(y * y) AS DOUBLE) AS ss
         FROM y GROUP BY a, b),
la AS (SELECT a, sum(n) AS n, sum(s) AS s FROM cell GROUP BY a),
lb AS (SELECT b, sum(n) AS n, sum(s) AS s FROM cell GROUP BY b),
w AS (SELECT la.a, la.n, la.s, coalesce(sum(c.n) FILTER (c.b = 'A'), 0) AS p, coalesce(sum(c.n) FILTER (c.b = 'N'), 0) AS q
      FROM la JOIN cell c ON c.a = la.a GROUP BY ALL),
m AS (
    SELECT (SELECT n FROM lb WHERE b = 'A') - sum(p * p / n) AS pp, -sum(p * q / n) AS pq,
           (SELECT n FROM lb WHERE b = 'N') - sum(q * q / n) AS qq,
           (SELECT s FROM lb WHERE b = 'A') - sum(p * s / n) AS rp,
           (SELECT s FROM lb WHERE b = 'N') - sum(q * s / n) AS rq FROM w),
t AS (
    SELECT (SELECT sum(ss - s * s / n) FROM cell) AS rss,
           (SELECT sum(s * s / n) FROM cell) AS between_cells,
           (SELECT sum(s * s / n) FROM la) AS between_a,
           (SELECT sum(s * s / n) FROM lb) AS between_b,
           (SELECT (rp * (qq * rp - pq * rq) + rq * (pp * rq - pq * rp)) / (pp * qq - pq * pq) FROM m) AS b_given_a,
           (SELECT CAST(sum(n) AS BIGINT) FROM cell) AS n,
           (SELECT count(*) FROM cell) AS cells,
           (SELECT count(*) FROM la) AS levels_a,
           (SELECT count(*) FROM lb) AS levels_b),
r AS (
    SELECT *, between_cells - between_a - b_given_a AS both_ss,
           n - cells AS df_rest, cells - levels_a - levels_b + 1 AS df_both FROM t)
SELECT 'l_linenumber' AS term, round((between_cells - between_b) - both_ss, -2) AS sum_sq, levels_a - 1 AS df,
       round(((between_cells - between_b) - both_ss) / (levels_a - 1) / (rss / df_rest), 6) AS f FROM r
UNION ALL
SELECT 'l_returnflag', round(b_given_a, -2), levels_b - 1, round(b_given_a / (levels_b - 1) / (rss / df_rest), 6) FROM r
UNION ALL
SELECT 'l_linenumber:l_returnflag', round(both_ss, -2), df_both, round(both_ss / df_both / (rss / df_rest), 6) FROM r
UNION ALL
SELECT 'Residual', round(rss, -2), df_rest, NULL FROM r"""

# 4.030 is the critical value for the six groups.
_TUKEY = """WITH g AS (
    SELECT concat(l_returnflag, l_linestatus) AS g, count(*) AS n, avg(l_extendedprice) AS m,
           var_pop(l_extendedprice) * count(*) AS within
    FROM lineitem GROUP BY 1),
t AS (SELECT CAST(sum(n) - count(*) AS BIGINT) AS df, sum(within) / (sum(n) - count(*)) AS mse FROM g),
p AS (
    SELECT x.g AS group1, y.g AS group2, y.m - x.m AS meandiff, sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n)) AS scale,
           CAST(4.030 AS DOUBLE) AS q_crit, df
    FROM g x JOIN g y ON x.g < y.g, t)
SELECT group1, group2, round(meandiff, 5) AS meandiff, round(meandiff - q_crit * scale, 5) AS lower,
       round(meandiff + q_crit * scale, 5) AS upper, round(abs(meandiff) / scale, 5) AS q, df,
       abs(meandiff) / scale > q_crit AS reject
FROM p"""

_JOINED = f"WITH {_EVENTS} SELECT event_id, ad_id, event_time, ad_id // 10 AS campaign_id FROM e WHERE {_KNOWN}"

_RESULT_ROWS = (
    '"testIndex", "countOfEvent", "latencyTime", "NumberOfNodes", "TestNumber", "System"'
)

_MS_TIME = "make_timestamp((epoch_us(event_time) // 1000) * 1000) AS event_time"

ORACLE: dict[str, str] = {
    "source_events": f"WITH {_EVENTS} SELECT event_id, event_time, user_id, event_type, value, ad_id FROM e",
    "source_events_json": f"WITH {_EVENTS} SELECT ad_id, event_type, {_MS_TIME} FROM e",
    "source_campaigns": f"WITH {_EVENTS} SELECT DISTINCT ad_id, ad_id // 10 AS campaign_id FROM e WHERE ad_id >= 0",
    "scan_result_csv": f"""{_TEN}, {_run('r', 'w', 0)}
SELECT "testIndex" AS _index, "countOfEvent" AS "0", "latencyTime" AS "1", "NumberOfNodes" AS "2",
       "TestNumber" AS "3", "System" AS "4", CAST(2 AS INTEGER) AS file_nodes, 'spark' AS file_system,
       CAST(0 AS INTEGER) AS file_test FROM r""",
    "scan_metric_text": f'{_TEN}, {_run("r", "w", 0)} SELECT "testIndex" AS idx, "latencyTime" AS value FROM r',
    "scan_metric_pairs": f'{_TEN}, {_run("r", "w", 0)} SELECT "testIndex" AS idx, "countOfEvent", "latencyTime" FROM r',
    "sink_window_upsert": f"{_TEN} {_COUNTS}",
    "extract_stats": f"{_TEN} SELECT campaign_id, window_start, seen_count, {_lag()} AS latency_ms FROM w",
    "sink_result_csv": f"""WITH {_EVENTS}, {_window_rows('10 seconds')}, {_window_rows('1 hour', 'h')},
{_run('r', 'w', 0)}, {_run('s', 'h', 1)}
SELECT {_RESULT_ROWS} FROM r UNION ALL SELECT {_RESULT_ROWS} FROM s""",
    "parse_event_json": f"""WITH {_EVENTS}
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS page_id, CAST(ad_id AS VARCHAR) AS ad_id,
       event_type, {_MS_TIME} FROM e""",
    "parse_event_json_rejects": "SELECT event_type = 'error' AS rejected, count(*) AS records FROM events GROUP BY 1",
    "filter_project_views": f"WITH {_EVENTS} SELECT ad_id, event_time FROM e WHERE event_type = 'view'",
    "label_result_columns": f"{_TEN}, {_run('r', 'w', 0)} SELECT {_RESULT_ROWS} FROM r",
    "tag_run_constants": f"""{_TEN}
SELECT campaign_id, window_start, seen_count, {_lag()} AS last_event_lag_ms, CAST(2 AS INTEGER) AS "NumberOfNodes",
       CAST(0 AS INTEGER) AS "TestNumber", 'spark' AS "System" FROM w""",
    "filter_by_nodes": """SELECT l_orderkey, l_linenumber AS "NumberOfNodes", l_linestatus AS "System",
       l_extendedprice AS "latencyTime" FROM lineitem WHERE l_linenumber = 2""",
    "latency_seconds": f"""{_TEN} SELECT campaign_id, window_start, {_lag()} AS "latencyTime",
       round(({_lag()}) / 1000.0, 6) AS latency_s FROM w""",
    "group_label": """SELECT l_orderkey, l_linenumber AS "NumberOfNodes", l_linestatus AS "System",
       CAST(l_linenumber AS VARCHAR) || l_linestatus AS groups FROM lineitem""",
    "positional_pair": """WITH s AS (
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS seen FROM orders),
u AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_custkey AS updated FROM orders
      WHERE o_orderstatus = 'O')
SELECT idx, seen, updated FROM s FULL JOIN u USING (idx)""",
    "join_campaign": _JOINED,
    "join_campaign_measured": _JOINED,
    "join_campaign_large_table": _JOINED,
    "join_campaign_stream": _JOINED,
    "join_campaign_unknown_ads": f"""WITH {_EVENTS} SELECT ad_id, count(*) AS events FROM e
WHERE event_type = 'view' AND (ad_id IS NULL OR ad_id NOT BETWEEN 0 AND 89) GROUP BY ad_id""",
    "stream_parity_by_day": f"""{_TEN},
d AS (SELECT CAST(window_start AS DATE) AS day, CAST(sum(seen_count) AS BIGINT) AS n FROM w GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN day = DATE '2024-01-10' THEN 0 ELSE n END AS streamed_views, n AS recounted_views,
       day <> DATE '2024-01-10' AS same FROM d""",
    "late_merge_closed_days": f"""{_HOUR},
h AS (SELECT CAST(window_start AS DATE) AS day, hour(window_start) % 2 = 0 AS early, seen_count FROM w),
o AS (SELECT max(day) FILTER (early) - 10 AS first, max(day) - 10 AS last FROM h),
s AS (SELECT day, CAST(sum(seen_count) AS BIGINT) AS views FROM h, o WHERE day >= last GROUP BY day),
r AS (SELECT day, CAST(sum(seen_count) AS BIGINT) AS refused_views FROM h, o WHERE day < first AND NOT early GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, views, refused_views FROM s FULL JOIN r USING (day)""",
    "latency_percentiles": f"""{_HOUR},
l AS (SELECT CAST(window_start AS DATE) AS day, {_lag()} AS ms FROM w),
b AS (SELECT day, CASE WHEN ms = 0 THEN NULL ELSE ceil(ln(ms) / ln(1.005 / CAST(0.995 AS DOUBLE))) END AS place, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY day ORDER BY place NULLS FIRST) AS past, sum(n) OVER (PARTITION BY day) AS all_n FROM b),
v AS (SELECT *, CASE WHEN place IS NULL THEN 0.0
             ELSE pow(1.005 / CAST(0.995 AS DOUBLE), place - 1) * (2 * 1.005 / 0.995) / (1.005 / CAST(0.995 AS DOUBLE) + 1) END AS value FROM c)
SELECT CAST(day AS VARCHAR) AS day, CAST(any_value(all_n) AS BIGINT) AS windows, round(min(value) FILTER (past > floor(CAST(0.5 AS DOUBLE) * (all_n - 1))), 6) AS p50_ms,
       round(min(value) FILTER (past > floor(CAST(0.99 AS DOUBLE) * (all_n - 1))), 6) AS p99_ms FROM v GROUP BY day""",
    "campaign_window_count": f"{_TEN} {_COUNTS}",
    "campaign_window_count_hourly": f"{_HOUR} {_COUNTS}",
    "campaign_window_count_large_table": f"{_HOUR} {_COUNTS}",
    "window_latency": f"{_TEN} SELECT campaign_id, window_start, seen_count, {_lag()} AS last_event_lag_ms FROM w",
    "campaign_window_count_stream": f"{_TEN} {_COUNTS}",
    "campaign_window_count_json_stream": f"{_TEN} {_COUNTS}",
    "campaign_window_count_watermark": f"{_HOUR} {_COUNTS}",
    "campaign_window_count_watermark_large_table": f"{_HOUR} {_COUNTS}",
    "late_merge": f"{_HOUR} {_COUNTS}",
    "stream_batch_parity": f"""{_TEN} SELECT count(*) AS windows, CAST(0 AS BIGINT) AS differing,
       CAST(sum(seen_count) AS BIGINT) AS streamed_views, CAST(sum(seen_count) AS BIGINT) AS recounted_views FROM w""",
    "stream_batch_differences": f"""{_HOUR} SELECT campaign_id, window_start, CAST(NULL AS BIGINT) AS streamed,
       seen_count AS recounted FROM w WHERE campaign_id >= 9""",
    "load_phase_rate": f"""WITH {_EVENTS}, {_PHASES},
c AS (SELECT phase, count(event_time) AS events FROM phases LEFT JOIN e ON event_time >= start_at AND event_time < end_at
      GROUP BY phase),
r AS (SELECT phase, events, (epoch_us(end_at) - epoch_us(start_at)) / 1e6 AS seconds, target_rate
      FROM c JOIN phases USING (phase))
SELECT phase, events, round(seconds, 9) AS seconds, target_rate, round(events / seconds, 9) AS observed_rate,
       round(events / seconds / target_rate, 9) AS share_of_target FROM r""",
    "load_phase_latency": f"""{_HOUR}, {_PHASES}
SELECT phase, count(*) AS windows, CAST(sum(seen_count) AS BIGINT) AS views, round(avg({_lag()}), 6) AS mean_latency_ms,
       max({_lag()}) AS max_latency_ms
FROM w JOIN phases ON window_start >= start_at AND window_start < end_at GROUP BY phase""",
    "load_phase_latency_stream": f"""{_HOUR}, {_PHASES}
SELECT phase, count(*) AS windows, CAST(sum(seen_count) AS BIGINT) AS views, round(avg({_lag()}), 6) AS mean_latency_ms,
       max({_lag()}) AS max_latency_ms
FROM w JOIN phases ON window_start >= start_at AND window_start < end_at GROUP BY phase""",
    "load_phase_rate_hours": f"""WITH {_EVENTS},
phases AS (
    SELECT CAST(h AS INTEGER) AS phase, TIMESTAMP '2024-01-01' + to_hours(h) AS start_at, 3600 AS length, {LOAD_RATE} AS target
    FROM range(744) r(h)
    UNION ALL SELECT CAST(1000 + d AS INTEGER), TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)), 86400, {REDUCED_LOAD_RATE} FROM range(31) r(d)),
c AS (SELECT phase, length, target, count(event_time) AS events
      FROM phases LEFT JOIN e ON event_time >= start_at AND event_time < start_at + to_seconds(length) GROUP BY ALL)
SELECT phase, events, CAST(length AS DOUBLE) AS seconds, CAST(target AS DOUBLE) AS target_rate, round(events / length, 9) AS observed_rate,
       round(events / CAST(length AS DOUBLE) / target, 9) AS share_of_target FROM c""",
    "describe_by_group": _DESCRIBE,
    "describe_by_group_large_groups": f"WITH {_KINDS} {_of_kinds(_DESCRIBE)}",
    "variance_by_group": "SELECT event_type, round(var_samp(value), 6) AS variance FROM events GROUP BY event_type",
    "variance_by_group_missing": f"WITH {_KINDS} SELECT kind, round(var_samp(value), 6) AS variance FROM k GROUP BY kind",
    "anova_two_way": _ANOVA,
    "anova_two_way_many_levels": _ANOVA_MANY,
    "tukey_hsd": _TUKEY,
    "binned_mean": """SELECT floor(l_quantity / 5.0) * 5.0 AS bin_start, count(*) AS rows,
       round(avg(l_extendedprice), 5) AS mean FROM lineitem GROUP BY 1""",
    "box_stats": _BOX,
    "box_stats_large_groups": f"WITH {_KINDS}, {_of_kinds(_BOX).removeprefix('WITH ')}".replace(
        "FROM k GROUP BY kind)", "FROM k WHERE value IS NOT NULL GROUP BY kind)"
    ),
    "head_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
    "union_runs": """SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_id % 2 <> 0""",
    "compare_runs": f"""{_HOUR},
r AS (SELECT CASE WHEN campaign_id % 2 = 0 THEN 2 ELSE 4 END AS nodes,
             CASE WHEN campaign_id // 2 % 2 = 0 THEN 'spark' ELSE 'spark2' END AS system,
             CAST({_lag()} AS DOUBLE) AS y FROM w)
SELECT system AS "System", CAST(nodes AS INTEGER) AS "NumberOfNodes", count(*) AS "count", round(avg(y), 6) AS mean,
       round(stddev_samp(y), 6) AS std, round(min(y), 6) AS min, round(quantile_cont(y, 0.25), 6) AS p25,
       round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, round(max(y), 6) AS max,
       round(var_samp(y), -2) AS variance, count(*) FILTER (y / 1000 NOT BETWEEN low AND high) AS outliers
FROM r JOIN (SELECT system, nodes, quantile_cont(y, 0.25) / 1000 AS q1, quantile_cont(y, 0.75) / 1000 AS q3,
                    q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM r GROUP BY ALL) USING (system, nodes)
GROUP BY system, nodes""",
    "window_latency_stream": f"""{_TEN} SELECT campaign_id, window_start, seen_count, TRUE AS after_last_event,
       TRUE AS after_start FROM w""",
}
