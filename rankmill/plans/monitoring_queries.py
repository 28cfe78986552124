"""Telemetry and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.operators import changes as ch
from rankmill.operators import monitoring as mn
from rankmill.plans.change_queries import CONTRACT, NOW, READY, now
from rankmill.plans.oracle import with_
from rankmill.plans.registry import query
from rankmill.plans.request_queries import ATTEMPTS, attempts

END = "TIMESTAMP '2024-01-15 12:00:00'"
WINDOW = f"(SELECT * FROM telemetry WHERE ts >= {END} - INTERVAL 3600 SECOND AND ts <= {END} + INTERVAL 60 SECOND)"


def end():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def nearest(column: str) -> str:
    return f"quantile_disc({column}, 0.95)"


@query("m01_route_counts_window", "store_id:i request_name:s route:s reason:s requests:i",
       with_("telemetry", f"SELECT store_id, request_name, route, reason, count(*) AS requests FROM {WINDOW} GROUP BY ALL"))
def _(t):
    return mn.route_counts(mn.in_window(t.telemetry, end(), 3600))


@query("m01_route_counts", "store_id:i request_name:s route:s reason:s requests:i",
       with_("telemetry", "SELECT store_id, request_name, route, reason, count(*) AS requests FROM telemetry GROUP BY ALL"))
def _(t):
    return mn.route_counts(t.telemetry)


@query("m02_fallback_ratio", "store_id:i request_name:s requests:i fallback_ratio:f6",
       with_("telemetry", "SELECT store_id, request_name, count(*) AS requests, count(*) FILTER (route = 'native_fallback') / count(*) AS fallback_ratio FROM telemetry GROUP BY 1, 2"))
def _(t):
    return mn.fallback_ratio(t.telemetry)


@query("m03_route_latency", "store_id:i request_name:s route:s observations:i p95_duration_ms:f6",
       with_("telemetry", f"SELECT store_id, request_name, route, count(*) AS observations, {nearest('duration_ms')} AS p95_duration_ms FROM telemetry GROUP BY 1, 2, 3"))
def _(t):
    return mn.route_latency(t.telemetry)


@query("m04_component_latency", "store_id:i request_name:s component:s outcome:s observations:i p95_duration_ms:f6",
       with_("components", f"SELECT store_id, request_name, component, outcome, count(*) AS observations, {nearest('ms')} AS p95_duration_ms FROM components GROUP BY 1, 2, 3, 4"))
def _(t):
    return mn.component_latency(t.telemetry)


@query("m05_window_quality", "window_complete:b records_rejected:i",
       f"SELECT coalesce(min(ts) FILTER (value >= 5) <= {END} - INTERVAL 3600 SECOND, false) AS window_complete, count(*) FILTER (value < 5) AS records_rejected FROM events")
def _(t):
    parsed = t.events.select((F.col("value") >= 5).alias("accepted"), "ts")
    return mn.window_quality(parsed, end(), 3600)


BACKLOG = f"SELECT store_id, lane, state, count(*) AS jobs, sum(attempt_count) AS attempts, sum(replay_count) AS manual_replays, greatest(0, epoch_us({NOW}) // 1000000 - epoch_us(min(created_at)) // 1000000) AS oldest_age_seconds FROM outbox GROUP BY 1, 2, 3"


@query("m06_backlog", "store_id:i lane:s state:s jobs:i attempts:i manual_replays:i oldest_age_seconds:i", with_("outbox", BACKLOG))
def _(t):
    return mn.backlog(t.outbox, now())


GENERATIONS = (
    "SELECT g.*, coalesce(s.active_generation_id = g.generation_id, false) AS active_for_store, CASE WHEN coverage_total = 0 THEN 100.0 ELSE round(coverage_complete / coverage_total * 100, 4) END AS coverage_percent, "
    "greatest(0, coalesce(h.head, 0) - captured_change_id) AS journal_lag, contract_digest = 'AUTOMOBILE' AS contract_current FROM generations g LEFT JOIN (SELECT store_id, max(change_id) AS head FROM journal GROUP BY 1) h USING (store_id) LEFT JOIN store_state s USING (store_id)"
)


@query("m07_generation_metrics", "generation_id:i store_id:i state:s active_for_store:b coverage_total:i coverage_percent:f4 journal_lag:i contract_current:b",
       with_("generations journal store_state", GENERATIONS))
def _(t):
    return mn.generation_metrics(t.generations, t.journal, t.store_state, CONTRACT)


DELIVERY = (
    f"SELECT subscription_id, count(*) AS traces, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, greatest(0, epoch_us({NOW}) // 1000000 - epoch_us(min(created)) // 1000000) AS oldest_age_seconds, "
    f"epoch_us(max(created)) // 1000000 AS last_trace_epoch, count(*) FILTER (NOT success AND last) AS unresolved_failures FROM (SELECT *, log_id = max(log_id) OVER (PARTITION BY subscription_id, uuid) AS last FROM {ATTEMPTS}) GROUP BY 1"
)


@query("m08_delivery_trace", "subscription_id:i traces:i successes:i failures:i unresolved_failures:i oldest_age_seconds:i last_trace_epoch:i", DELIVERY)
def _(t):
    return mn.delivery_trace(attempts(t), now())


@query("m09_event_counts", "event_type:s store_id:i events:i", "SELECT event_type, user_id % 3 + 1 AS store_id, count(*) AS events FROM events GROUP BY 1, 2")
def _(t):
    return mn.event_counts(t.events.withColumn("store_id", F.col("user_id") % 3 + 1), ["event_type", "store_id"])


_SUBS = f"(SELECT subscription_id AS store_id, subscription_id % 3 <> 1 AS healthy, unresolved_failures FROM ({DELIVERY}))"
ALERTS = (
    f"SELECT 'critical' AS severity, 'active_generation_not_ready' AS code, store_id, active_generation_id AS generation_id FROM ({READY}) WHERE activation_mode = 'HYBRID' AND NOT ready UNION ALL "
    f"SELECT 'critical', 'active_generation_coverage_gap', store_id, generation_id FROM ({GENERATIONS}) WHERE active_for_store AND (coverage_complete <> coverage_total OR coverage_failed <> 0) UNION ALL "
    f"SELECT 'critical', 'active_encoder_identity_missing', store_id, generation_id FROM ({GENERATIONS}) WHERE active_for_store AND NOT is_fake AND encoder_identity_digest IS NULL UNION ALL "
    f"SELECT 'critical', 'active_generation_contract_drift', store_id, generation_id FROM ({GENERATIONS}) WHERE active_for_store AND NOT contract_current UNION ALL "
    f"SELECT 'high', 'generation_refresh_state_failed', store_id, generation_id FROM ({GENERATIONS}) WHERE refresh_state = 'RESTORE_FAILED' UNION ALL "
    f"SELECT 'critical', 'ready_generation_refresh_not_restored', store_id, generation_id FROM ({GENERATIONS}) WHERE state = 'READY' AND coalesce(refresh_state, '') <> 'RESTORED' UNION ALL "
    f"SELECT 'high', 'oldest_unresolved_work_exceeded', store_id, NULL FROM ({BACKLOG}) WHERE state NOT IN ('COMPLETED', 'SUPERSEDED', 'DEAD') AND oldest_age_seconds > 900 UNION ALL "
    f"SELECT 'high', 'dead_letter_nonzero', store_id, NULL FROM ({BACKLOG}) WHERE state = 'DEAD' UNION ALL "
    f"SELECT 'high', 'subscription_definition_drift', store_id, NULL FROM {_SUBS} WHERE NOT healthy UNION ALL "
    f"SELECT 'high', 'async_event_handoff_failure', store_id, NULL FROM {_SUBS} WHERE unresolved_failures > 0 UNION ALL "
    f"SELECT 'high', 'trace_retention_overdue', subscription_id, NULL FROM ({DELIVERY}) WHERE oldest_age_seconds > 1640000"
)
_ALERT_TABLES = "store_state generations journal outbox"


def parts(t):
    ready = ch.readiness(t.store_state)
    generations = mn.generation_metrics(t.generations, t.journal, t.store_state, CONTRACT)
    work = mn.backlog(t.outbox, now())
    deliveries = mn.delivery_trace(attempts(t), now())
    subscriptions = deliveries.select(
        F.col("subscription_id").alias("store_id"), (F.col("subscription_id") % 3 != 1).alias("healthy"), "unresolved_failures"
    )
    cleanup = deliveries.select(F.col("subscription_id").alias("store_id"), (F.col("oldest_age_seconds") > 1_640_000).alias("overdue"))
    fired = mn.alerts(ready, generations, work, subscriptions, cleanup)
    return ready, generations, work, deliveries, fired


@query("m10_alerts", "severity:s code:s store_id:i generation_id:i",
       with_(_ALERT_TABLES, f"SELECT severity, code, store_id, coalesce(generation_id, -1) AS generation_id FROM ({ALERTS})"))
def _(t):
    return parts(t)[4].withColumn("generation_id", F.coalesce("generation_id", F.lit(-1)))


# One step is six hours here: the sample events are sparse.
_STEP = 21_600
_SAMPLES = (
    f"SELECT store_id, request_name, epoch_us(ts) // 1000000 // {_STEP} * {_STEP} AS t, count(*) AS requests, count(*) FILTER (route = 'native_fallback') / count(*) AS fallback_ratio, "
    f"quantile_disc(duration_ms, 0.95) FILTER (route = 'hybrid') AS hybrid_p95 FROM telemetry GROUP BY 1, 2, 3"
)
_FIRING = (
    f"SELECT 'query_fallback_rate_high' AS code, store_id, request_name, t, requests >= 10 AND fallback_ratio > 0.05 AS firing FROM ({_SAMPLES}) UNION ALL "
    f"SELECT 'query_latency_high', store_id, request_name, t, requests >= 10 AND coalesce(hybrid_p95 > 100, false) FROM ({_SAMPLES})"
)


@query("m11_threshold_samples", "store_id:i request_name:s t:i requests:i fallback_ratio:f6 hybrid_p95:f6",
       with_("telemetry", f"SELECT * REPLACE (coalesce(hybrid_p95, -1) AS hybrid_p95) FROM ({_SAMPLES})"))
def _(t):
    return mn.threshold_samples(t.telemetry, _STEP).withColumn("hybrid_p95", F.coalesce("hybrid_p95", F.lit(-1.0)))


@query(
    "m11_threshold_alerts", "code:s store_id:i request_name:s t:i firing:b held:b",
    with_("telemetry", f"SELECT *, bool_and(firing) OVER w AND t - min(t) OVER w >= {2 * _STEP} AS held FROM ({_FIRING}) WINDOW w AS (PARTITION BY code, store_id, request_name ORDER BY t RANGE BETWEEN {2 * _STEP} PRECEDING AND CURRENT ROW)"),
)
def _(t):
    samples = mn.threshold_samples(t.telemetry, _STEP)
    return mn.threshold_alerts(samples, latency_limit=100.0, minimum_requests=10, hold_seconds=2 * _STEP)


# Counters that restart whenever their running total passes a round number.
_COUNTERS = "SELECT user_id % 5 AS instance, epoch_us(ts) // 1000000 * 1000 + event_id % 1000 AS t, event_id // 5 % 400 AS total, event_id // 35 % 60 AS errors FROM events"


@query(
    "m12_error_rate", "instance:i t:i request_increase:i error_increase:i error_rate:f6 firing:b",
    f"SELECT *, error_increase / greatest(request_increase, 1) AS error_rate, error_increase / greatest(request_increase, 1) > 0.01 AND request_increase >= 20 AS firing FROM ("
    f"SELECT instance, t, CAST(sum(dt) OVER w AS BIGINT) AS request_increase, CAST(sum(de) OVER w AS BIGINT) AS error_increase FROM (SELECT instance, t, CASE WHEN pt IS NULL THEN 0 WHEN total < pt THEN total ELSE total - pt END AS dt, CASE WHEN pe IS NULL THEN 0 WHEN errors < pe THEN errors ELSE errors - pe END AS de "
    f"FROM (SELECT *, lag(total) OVER o AS pt, lag(errors) OVER o AS pe FROM ({_COUNTERS}) WINDOW o AS (PARTITION BY instance ORDER BY t))) WINDOW w AS (PARTITION BY instance ORDER BY t RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW))",
)
def _(t):
    counters = t.events.selectExpr(
        "user_id % 5 instance", "unix_seconds(ts) * 1000 + event_id % 1000 t", "event_id div 5 % 400 total", "event_id div 35 % 60 errors"
    )
    return mn.error_rate(counters, ["instance"], seconds=7_200_000)


@query("m12_saturation", "part:i saturation:f6 saturated:b",
       "SELECT p_partkey AS part, p_size / greatest(p_size % 17 * 4, 1) AS saturation, p_size / greatest(p_size % 17 * 4, 1) >= 0.9 AS saturated FROM part")
def _(t):
    gauges = t.raw("part").selectExpr("p_partkey part", "p_size inflight", "p_size % 17 * 4 concurrency_limit")
    return mn.saturated(gauges)


@query("m13_similarity_outcomes", "store_id:i threshold_profile_id:s requests:i fallback_rate:f6 empty_rate:f6 mean_results:f6 mean_duration_ms:f6 maximum_duration_ms:f6",
       "SELECT user_id % 3 + 1 AS store_id, event_type AS threshold_profile_id, count(*) AS requests, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) AS fallback_rate, avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END) AS empty_rate, avg(event_id % 7) AS mean_results, avg(value) AS mean_duration_ms, max(value) AS maximum_duration_ms FROM events GROUP BY 1, 2")
def _(t):
    rows = t.events.selectExpr(
        "user_id % 3 + 1 store_id", "event_type threshold_profile_id", "if(value < 20, 'fallback', 'success') outcome",
        "event_id % 7 result_count", "value duration_ms",
    )
    return mn.similarity_outcomes(rows)


_LONG = (
    "SELECT metric, labels, value FROM ("
    f"SELECT unnest(['ready', 'native_lag', 'hybrid_lag']) AS metric, 'store_id=' || store_id AS labels, unnest([CAST(ready AS DOUBLE), native_lag, hybrid_lag]) AS value FROM ({READY}) UNION ALL "
    f"SELECT unnest(['active_for_store', 'coverage_total', 'coverage_complete', 'coverage_failed', 'coverage_percent', 'journal_lag', 'contract_current']), 'store_id=' || store_id || ',generation_id=' || generation_id || ',state=' || state, "
    f"unnest([CAST(active_for_store AS DOUBLE), coverage_total, coverage_complete, coverage_failed, coverage_percent, journal_lag, CAST(contract_current AS DOUBLE)]) FROM ({GENERATIONS}) UNION ALL "
    f"SELECT unnest(['jobs', 'attempts', 'manual_replays', 'oldest_age_seconds']), 'store_id=' || store_id || ',lane=' || lane || ',state=' || state, unnest([CAST(jobs AS DOUBLE), attempts, manual_replays, oldest_age_seconds]) FROM ({BACKLOG}) UNION ALL "
    f"SELECT unnest(['traces', 'successes', 'failures', 'unresolved_failures', 'oldest_age_seconds']), 'subscription_id=' || subscription_id, unnest([CAST(traces AS DOUBLE), successes, failures, unresolved_failures, oldest_age_seconds]) FROM ({DELIVERY}) UNION ALL "
    f"SELECT 'operations_alerts', 'store_id=' || store_id || ',severity=' || severity || ',code=' || code, CAST(count(*) AS DOUBLE) FROM ({ALERTS}) GROUP BY store_id, severity, code)"
)


@query("m15_operations_snapshot", "metric:s labels:s value:f4", with_(_ALERT_TABLES, _LONG))
def _(t):
    long = mn.operations_snapshot(*parts(t))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return long.withColumn("labels", F.array_join(pairs, ","))


@query("s11_metric_samples", "metric:s store:s lane:s value:f4",
       with_("outbox", f"SELECT unnest(['jobs', 'attempts', 'manual_replays']) AS metric, CAST(store_id AS VARCHAR) AS store, lane, unnest([jobs, attempts, manual_replays]) AS value FROM ({BACKLOG})"))
def _(t):
    rows = mn.metric_samples(mn.backlog(t.outbox, now()), ["store_id", "lane", "state"], ["jobs", "attempts", "manual_replays"])
    return rows.select("metric", F.col("labels")["store_id"].alias("store"), F.col("labels")["lane"].alias("lane"), "value")


FAILURES = (
    "SELECT store_id, sequence, us, row_number() OVER (PARTITION BY store_id, run ORDER BY us, sequence) AS failures FROM ("
    "SELECT *, sum(CASE WHEN success OR us - pus > {memory} THEN 1 ELSE 0 END) OVER (PARTITION BY store_id ORDER BY us, sequence) AS run FROM ("
    "SELECT user_id % 3 + 1 AS store_id, event_id AS sequence, epoch_us(ts) AS us, event_type NOT IN ('error', 'view', 'click') AS success, lag(epoch_us(ts)) OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts), event_id) AS pus FROM events)) WHERE NOT success"
)


def outcomes(t):
    return t.events.selectExpr("user_id % 3 + 1 store_id", "ts", "event_id sequence", "event_type not in ('error', 'view', 'click') success")


@query("st4_failure_runs", "store_id:i sequence:i failures:i opens:b open_until_us:i",
       "SELECT *, failures >= 3 AS opens, CASE WHEN failures >= 3 THEN us + 30000000 ELSE -1 END AS open_until_us FROM (" + FAILURES.format(memory=10**15) + ")")
def _(t):
    runs = mn.failure_runs(outcomes(t), memory_seconds=None)
    return runs.withColumn("open_until_us", F.coalesce(F.unix_micros("open_until"), F.lit(-1)))


@query("st4_failure_runs_memory", "store_id:i sequence:i failures:i",
       FAILURES.format(memory=1_800_000_000))
def _(t):
    return mn.failure_runs(outcomes(t), memory_seconds=1800)
