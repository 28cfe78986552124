"""Telemetry and operations metrics in batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankmill.operators.joins import unresolved_failures
from rankmill.operators.ordering import exact_percentiles
from rankmill.session import broadcast_if_small

WINDOW_MINIMUM, WINDOW_MAXIMUM = 60, 3600
FUTURE_SECONDS = 60
TERMINAL_STATES = ("COMPLETED", "SUPERSEDED", "DEAD")


def in_window(telemetry: DataFrame, generated_at: Column, seconds: int) -> DataFrame:
    """Records of the look-back window; clock skew up to a minute ahead is tolerated."""
    if not WINDOW_MINIMUM <= seconds <= WINDOW_MAXIMUM:
        raise ValueError("the window must be between 60 and 3600 seconds")
    low = generated_at - F.make_interval(secs=F.lit(seconds))
    high = generated_at + F.make_interval(secs=F.lit(FUTURE_SECONDS))
    return telemetry.where((F.col("ts") >= low) & (F.col("ts") <= high))


def route_counts(window: DataFrame) -> DataFrame:
    return window.groupBy("store_id", "request_name", "route", "reason").agg(
        F.count(F.lit(1)).alias("requests")
    )


def fallback_ratio(window: DataFrame, by: Sequence[str] = ("store_id", "request_name")) -> DataFrame:
    fallbacks = F.count_if(F.col("route") == "native_fallback")
    return window.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), (fallbacks / F.count(F.lit(1))).alias("fallback_ratio")
    )


def _nearest_p95(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(*by).agg(F.count("duration_ms").alias("observations"))
    points = exact_percentiles(rows, by, "duration_ms", {"p95_duration_ms": 0.95}, rule="nearest")
    return counts.join(points, list(by))


def route_latency(window: DataFrame, by: Sequence[str] = ("store_id", "request_name", "route")) -> DataFrame:
    """Observations and nearest-rank p95."""
    return _nearest_p95(window, by)


def component_latency(window: DataFrame) -> DataFrame:
    """The same per (store, request, component, outcome)."""
    parts = window.select(
        "store_id", "request_name", F.explode("components").alias("component", "__m")
    ).select(
        "store_id", "request_name", "component", F.col("__m.outcome").alias("outcome"),
        F.col("__m.duration_ms").alias("duration_ms"),
    )
    return _nearest_p95(parts, ["store_id", "request_name", "component", "outcome"])


def window_quality(parsed: DataFrame, generated_at: Column, seconds: int) -> DataFrame:
    """One row: whether the log reaches back to the window's start, and rejected records.

    `parsed` has one row per log record with `accepted` and, when accepted, `ts`.
    """
    low = generated_at - F.make_interval(secs=F.lit(seconds))
    return parsed.agg(
        F.coalesce(F.min(F.when(F.col("accepted"), F.col("ts"))) <= low, F.lit(False)).alias("window_complete"),
        F.count_if(~F.col("accepted")).alias("records_rejected"),
    )


def age_seconds(moment: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(moment))


def backlog(outbox: DataFrame, now: Column) -> DataFrame:
    return outbox.groupBy("store_id", "lane", "state").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("attempt_count").alias("attempts"),
        F.sum("replay_count").alias("manual_replays"),
        age_seconds(F.min("created_at"), now).alias("oldest_age_seconds"),
    )


def generation_metrics(
    generations: DataFrame, journal: DataFrame, store_state: DataFrame, contract: dict[str, str]
) -> DataFrame:
    """Coverage percentage, journal lag, active flag and whether the contract is current."""
    heads = journal.groupBy("store_id").agg(F.max("change_id").alias("__head"))
    active = store_state.select("store_id", F.col("active_generation_id").alias("__active"))
    current = F.lit(True)
    for name, value in contract.items():
        current = current & F.col(name).eqNullSafe(F.lit(value))
    total = F.col("coverage_total")
    return (
        generations.join(broadcast_if_small(heads), "store_id", "left")
        .join(broadcast_if_small(active), "store_id", "left")
        .select(
            "generation_id", "store_id", "state",
            F.coalesce(F.col("__active") == F.col("generation_id"), F.lit(False)).alias("active_for_store"),
            "coverage_total", "coverage_complete", "coverage_failed",
            F.when(total == 0, 100.0)
            .otherwise(F.round(F.col("coverage_complete") / total * 100, 4)).alias("coverage_percent"),
            F.greatest(
                F.lit(0), F.coalesce("__head", F.lit(0)) - F.col("captured_change_id")
            ).alias("journal_lag"),
            current.alias("contract_current"),
            "is_fake", "encoder_identity_digest", "refresh_state",
        )
    )


def delivery_trace(attempts: DataFrame, now: Column) -> DataFrame:
    """Per subscription: attempts, successes, failures, unresolved failures, oldest age, newest."""
    base = attempts.groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("traces"),
        F.count_if(F.col("success")).alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        age_seconds(F.min("created"), now).alias("oldest_age_seconds"),
        F.unix_seconds(F.max("created")).alias("last_trace_epoch"),
    )
    open_failures = unresolved_failures(attempts).groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("__open")
    )
    return base.join(open_failures, "subscription_id", "left").withColumn(
        "unresolved_failures", F.coalesce("__open", F.lit(0))
    ).drop("__open")


def event_counts(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    return table.groupBy(*dims).agg(F.count(F.lit(1)).alias("events"))


# -- alerts --------------------------------------------------------------------------------------

def _alert(rows: DataFrame, when: Column, severity: str, code: str, generation: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return rows.where(when).select(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"),
        F.col("store_id").cast("long").alias("store_id"),
        (none if generation is None else generation.cast("long")).alias("generation_id"),
    )


def alerts(
    ready: DataFrame, generations: DataFrame, work: DataFrame, subscriptions: DataFrame,
    cleanup: DataFrame, work_age_limit: int = 900,
) -> DataFrame:
    """(severity, code, store_id, generation_id) of every rule that fires.

    Inputs are the metric tables of this module, plus `subscriptions` (store_id, healthy,
    unresolved_failures) and `cleanup` (store_id, overdue).
    """
    active, generation = F.col("active_for_store"), F.col("generation_id")
    no_identity = F.col("encoder_identity_digest").isNull()
    refresh = F.coalesce("refresh_state", F.lit(""))
    rules = [
        _alert(ready, (F.col("activation_mode") == "HYBRID") & ~F.col("ready"),
               "critical", "active_generation_not_ready", F.col("active_generation_id")),
        _alert(generations, active & (
            (F.col("coverage_complete") != F.col("coverage_total")) | (F.col("coverage_failed") != 0)),
               "critical", "active_generation_coverage_gap", generation),
        _alert(generations, active & ~F.col("is_fake") & no_identity,
               "critical", "active_encoder_identity_missing", generation),
        _alert(generations, active & ~F.col("contract_current"),
               "critical", "active_generation_contract_drift", generation),
        _alert(generations, refresh.isin("SUPPRESS_FAILED", "RESTORE_FAILED"),
               "high", "generation_refresh_state_failed", generation),
        _alert(generations, (F.col("state") == "READY") & (refresh != "RESTORED"),
               "critical", "ready_generation_refresh_not_restored", generation),
        _alert(work, ~F.col("state").isin(*TERMINAL_STATES) & (F.col("oldest_age_seconds") > work_age_limit),
               "high", "oldest_unresolved_work_exceeded"),
        _alert(work, (F.col("state") == "DEAD") & (F.col("jobs") > 0), "high", "dead_letter_nonzero"),
        _alert(subscriptions, ~F.col("healthy"), "high", "subscription_definition_drift"),
        _alert(subscriptions, F.col("unresolved_failures") > 0, "high", "async_event_handoff_failure"),
        _alert(cleanup, F.col("overdue"), "high", "trace_retention_overdue"),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def _trailing(rows: DataFrame, keys: Sequence[str], seconds: int, values: Sequence[Column], chunk: int = 86_400) -> DataFrame:
    """Aggregates over each row's trailing `seconds`, for series of any length.

    Series are cut into chunks at least as long as the window; the last `seconds` of a chunk are
    also copied into the next one, so a row has two copies at most and a task orders one chunk.
    `t` is the row time in seconds.
    """
    t, chunk = F.col("t"), max(chunk, seconds)
    own = F.floor(t / chunk)
    reach = F.floor((t + seconds) / chunk)
    spread = rows.withColumn("__chunk", F.explode(F.sequence(own, reach))).withColumn(
        "__own", own == F.col("__chunk")
    )
    window = W.partitionBy(*keys, "__chunk").orderBy("t").rangeBetween(-seconds, 0)
    return spread.select(
        "*", *[v.over(window).alias(f"__w{i}") for i, v in enumerate(values)]
    ).where(F.col("__own")).drop("__own", "__chunk")


def _trailing_sums(rows: DataFrame, keys: Sequence[str], seconds: int, values: Sequence[str], chunk: int = 86_400) -> DataFrame:
    """Sums over each row's trailing `seconds`, as `__w0` and so on, in chunks like `_trailing`.

    A row enters at its time and leaves, with its value taken off, right after `seconds`: a running sum over both is the
    sum of the window, so the work per row does not grow with the rows in a window.
    """
    chunk = max(chunk, seconds)
    own, last = F.floor(F.col("t") / chunk), F.floor((F.col("t") + seconds) / chunk)
    away = F.col("__end") == 1
    moves = (
        rows.withColumn("__chunk", F.explode(F.sequence(own, last)))
        .withColumn("__own", own == F.col("__chunk"))
        .withColumn("__end", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("__at", F.when(away, F.col("t") + seconds).otherwise(F.col("t")))
        .where(F.floor(F.col("__at") / chunk) <= F.col("__chunk"))  # later ones leave no row of the chunk
    )
    window = W.partitionBy(*keys, "__chunk").orderBy("__at", "__end").rangeBetween(W.unboundedPreceding, W.currentRow)
    sums = [F.sum(F.when(away, -F.col(v)).otherwise(F.col(v))).over(window).alias(f"__w{i}") for i, v in enumerate(values)]
    return moves.select("*", *sums).where(F.col("__own") & ~away).drop("__own", "__chunk", "__end", "__at")


def held_alerts(
    samples: DataFrame, keys: Sequence[str], hold_seconds: int = 300
) -> DataFrame:
    """Samples (keys, t, firing) with `held`: the condition was true for the whole hold time."""
    out = _trailing(
        samples, keys, hold_seconds,
        [F.bool_and("firing"), F.min("t")],
    )
    return out.withColumn(
        "held", F.col("__w0") & (F.col("t") - F.col("__w1") >= hold_seconds)
    ).drop("__w0", "__w1")


def threshold_samples(telemetry: DataFrame, step_seconds: int = 60) -> DataFrame:
    """(store_id, request_name, t, requests, fallback_ratio, hybrid_p95) per step."""
    t = (F.floor(F.unix_seconds("ts") / step_seconds) * step_seconds).alias("t")
    stepped = telemetry.withColumn("t", t)
    by = ["store_id", "request_name", "t"]
    p95 = exact_percentiles(
        stepped.where(F.col("route") == "hybrid"), by, "duration_ms", {"hybrid_p95": 0.95}, "nearest"
    )
    return fallback_ratio(stepped, by).join(p95, by, "left")


def threshold_alerts(
    samples: DataFrame, fallback_limit: float = 0.05, latency_limit: float = 200.0,
    minimum_requests: int = 20, hold_seconds: int = 300,
) -> DataFrame:
    """(code, store_id, request_name, t, held) for both query rules at every sample."""
    enough = F.col("requests") >= minimum_requests
    rules = F.array(
        F.struct(F.lit("query_fallback_rate_high").alias("code"),
                 (enough & (F.col("fallback_ratio") > fallback_limit)).alias("firing")),
        F.struct(F.lit("query_latency_high").alias("code"),
                 (enough & F.coalesce(F.col("hybrid_p95") > latency_limit, F.lit(False))).alias("firing")),
    )
    spread = samples.select("store_id", "request_name", "t", F.inline(rules))
    return held_alerts(spread, ["code", "store_id", "request_name"], hold_seconds)


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunk: Column) -> DataFrame:
    """Add `previous_<value>` in series order, for series of any length.

    `chunk` must grow with the order. Within a chunk it is a plain lag; the first row of a chunk
    takes the last row of the nearest earlier chunk, found among one row per chunk.
    """
    keys = list(keys)
    cut = rows.withColumn("__chunk", chunk)
    last = cut.groupBy(*keys, "__chunk").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    )
    by_chunk = W.partitionBy(*keys).orderBy("__chunk")
    carried = last.select(*keys, "__chunk", F.lag("__last").over(by_chunk).alias("__carry"))
    inside = W.partitionBy(*keys, "__chunk").orderBy(*order)
    return (
        cut.withColumn("__prev", F.lag(F.struct(*values)).over(inside))
        .join(carried, [*keys, "__chunk"])
        .withColumn("__prev", F.coalesce("__prev", "__carry"))
        .select(*rows.columns, *[F.col(f"__prev.{v}").alias(f"previous_{v}") for v in values])
    )


def error_rate(
    counters: DataFrame, keys: Sequence[str], seconds: int = 300, limit: float = 0.01,
    minimum_requests: int = 20,
) -> DataFrame:
    """Counter samples (keys, t, total, errors) with increases over the trailing window.

    A counter below its previous value was reset and restarted from zero.
    """
    stepped = with_previous(counters, keys, ["t"], ["total", "errors"], F.floor(F.col("t") / 86_400))

    def increase(name: str) -> Column:
        now, before = F.col(name), F.col(f"previous_{name}")
        return F.when(before.isNull(), 0).when(now < before, now).otherwise(now - before)

    deltas = stepped.select(
        *keys, "t", increase("total").alias("__dt"), increase("errors").alias("__de")
    )
    out = _trailing_sums(deltas, keys, seconds, ["__dt", "__de"])
    rate = F.col("error_increase") / F.greatest(F.col("request_increase"), F.lit(1))
    return out.select(
        *keys, "t", F.col("__w0").alias("request_increase"), F.col("__w1").alias("error_increase")
    ).withColumn("error_rate", rate).withColumn(
        "firing", (F.col("error_rate") > limit) & (F.col("request_increase") >= minimum_requests)
    )


def saturated(gauges: DataFrame, limit: float = 0.9) -> DataFrame:
    """Instances whose in-flight requests use at least the given share of their slots."""
    share = F.col("inflight") / F.greatest(F.col("concurrency_limit"), F.lit(1))
    return gauges.withColumn("saturation", share).withColumn("saturated", share >= limit)


def similarity_outcomes(telemetry: DataFrame) -> DataFrame:
    """Per (store, profile): requests, fallback and empty rates, mean result count and latency."""
    return telemetry.groupBy("store_id", "threshold_profile_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((F.col("outcome") == "fallback").cast("double")).alias("fallback_rate"),
        F.avg((F.col("result_count") == 0).cast("double")).alias("empty_rate"),
        F.avg("result_count").alias("mean_results"),
        F.avg("duration_ms").alias("mean_duration_ms"),
        F.max("duration_ms").alias("maximum_duration_ms"),
    )


def metric_samples(rows: DataFrame, labels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric rows to (metric, labels, value); booleans become 0 or 1, nulls are left out."""
    names = F.map_from_arrays(
        F.array(*[F.lit(c) for c in labels]), F.array(*[F.col(c).cast("string") for c in labels])
    )
    values = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return rows.select(names.alias("labels"), F.inline(values)).where(
        F.col("value").isNotNull()
    ).select("metric", "labels", "value")


def operations_snapshot(
    ready: DataFrame, generations: DataFrame, work: DataFrame, deliveries: DataFrame,
    fired: DataFrame,
) -> DataFrame:
    """All operations metrics in one long table (metric, labels, value)."""
    counted = fired.groupBy("store_id", "severity", "code").agg(
        F.count(F.lit(1)).alias("operations_alerts")
    )
    parts = [
        metric_samples(ready, ["store_id"], ["ready", "native_lag", "hybrid_lag"]),
        metric_samples(
            generations, ["store_id", "generation_id", "state"],
            ["active_for_store", "coverage_total", "coverage_complete", "coverage_failed",
             "coverage_percent", "journal_lag", "contract_current"],
        ),
        metric_samples(
            work, ["store_id", "lane", "state"],
            ["jobs", "attempts", "manual_replays", "oldest_age_seconds"],
        ),
        metric_samples(
            deliveries, ["subscription_id"],
            ["traces", "successes", "failures", "unresolved_failures", "oldest_age_seconds"],
        ),
        metric_samples(counted, ["store_id", "severity", "code"], ["operations_alerts"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- failure runs --------------------------------------------------------------------------------

def failure_runs(
    outcomes: DataFrame, threshold: int = 3, open_seconds: int = 30, memory_seconds: int | None = 60,
    keys: Sequence[str] = ("store_id",),
) -> DataFrame:
    """Failures (keys, ts, sequence, success) with their count in a row and the period they open.

    A success, or a pause longer than the memory, restarts the count. Days are counted apart and
    linked by one row per day, so a busy store never sits in one task.
    """
    keys = list(keys)
    order = ["ts", "sequence"]
    chunk = F.floor(F.unix_seconds("ts") / 86_400)
    linked = with_previous(outcomes.select(*keys, *order, "success"), keys, order, ["ts", "success"], chunk)
    paused = F.lit(False)
    if memory_seconds is not None:
        paused = F.unix_micros("ts") - F.unix_micros("previous_ts") > memory_seconds * 1_000_000
    fail = ~F.col("success")
    restart = F.col("success") | F.col("previous_ts").isNull() | F.col("previous_success") | paused
    rows = linked.withColumn("__chunk", chunk).withColumn("__restart", restart)
    inside = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    rows = rows.withColumn("__segment", F.sum(F.col("__restart").cast("int")).over(inside))
    segment = W.partitionBy(*keys, "__chunk", "__segment").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    rows = rows.withColumn("__local", F.sum(fail.cast("int")).over(segment))
    ends = rows.groupBy(*keys, "__chunk").agg(
        F.max("__segment").alias("__segments"),
        F.max_by("__local", F.struct(*order)).alias("__tail"),
    )
    by_chunk = W.partitionBy(*keys).orderBy("__chunk")
    ends = ends.withColumn(
        "__group", F.sum((F.col("__segments") > 0).cast("int")).over(by_chunk)
    )
    in_group = W.partitionBy(*keys, "__group").orderBy("__chunk")
    ends = ends.withColumn("__sum", F.sum("__tail").over(in_group)).withColumn(
        "__carry", F.coalesce(F.lag("__sum").over(by_chunk), F.lit(0))
    )
    counted = rows.join(ends.select(*keys, "__chunk", "__carry"), [*keys, "__chunk"]).withColumn(
        "failures",
        F.col("__local") + F.when(F.col("__segment") == 0, F.col("__carry")).otherwise(0),
    )
    return counted.where(fail).select(
        *keys, "ts", "sequence", "failures",
        (F.col("failures") >= threshold).alias("opens"),
        F.when(
            F.col("failures") >= threshold, F.col("ts") + F.make_interval(secs=F.lit(open_seconds))
        ).alias("open_until"),
    )
