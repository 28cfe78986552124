"""Choosing settings, and the stability, recall and latency rules around a choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import squeeze
from rankmill.operators.ordering import exact_percentiles
from rankmill.session import broadcast_if_small

LATENCY_POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def pick_best(
    grid: DataFrame, by: Sequence[str] = (), metric: str = "value", order: str = "position"
) -> DataFrame:
    """Best metric value; the first registered setting wins ties."""
    best = F.max_by(
        F.struct(*grid.columns), F.struct(F.col(metric), -F.col(order))
    )
    return grid.groupBy(*by).agg(best.alias("__best")).select("__best.*")


def dev_test(per_query: DataFrame, metric: str = "value") -> DataFrame:
    """Choose the setting on `dev`, report it once on `test`.

    Input: (split, setting, position, query_id, value) for all settings on both splits.
    """
    means = per_query.groupBy("split", "setting", "position").agg(F.avg(metric).alias("value"))
    chosen = pick_best(means.where(F.col("split") == "dev")).select(
        "setting", F.col("value").alias("dev_value")
    )
    test = means.where(F.col("split") == "test").select(
        "setting", F.col("value").alias("test_value")
    )
    return test.join(F.broadcast(chosen), "setting")  # one chosen row


def ranking_stability(reference: DataFrame, candidate: DataFrame, cutoff: int = 10) -> DataFrame:
    """One row: queries, mean and 5th-percentile overlap of the first `cutoff`, top-1 agreement.

    Overlap takes at most `cutoff + 1` values, so the percentile's buffer is bounded.
    """
    a = reference.where(F.col("rank") <= cutoff).select("query_id", "document_id", F.col("rank").alias("a"))
    b = candidate.where(F.col("rank") <= cutoff).select("query_id", "document_id", F.col("rank").alias("b"))
    per_query = a.join(b, ["query_id", "document_id"], "full_outer").groupBy("query_id").agg(
        (F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.lit(float(cutoff))).alias("overlap"),
        F.max(F.when((F.col("a") == 1) & (F.col("b") == 1), 1).otherwise(0)).alias("top1"),
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("overlap").alias("mean_overlap"),
        F.percentile("overlap", 0.05).alias("p05_overlap"),
        F.avg("top1").alias("top1_agreement"),
    )


def quality_guard(
    stability: DataFrame, reference_ndcg: Column, candidate_ndcg: Column,
    maximum_loss: float = 0.01, mean_overlap: float = 0.80, p05_overlap: float = 0.60,
    top1: float = 0.75,
) -> DataFrame:
    """Loss and stability checks of a cheaper query encoder, with the verdict."""
    checked = stability.withColumn("ndcg_loss", reference_ndcg - candidate_ndcg)
    checks = {
        "loss_ok": F.col("ndcg_loss") <= maximum_loss,
        "mean_overlap_ok": F.col("mean_overlap") >= mean_overlap,
        "p05_overlap_ok": F.col("p05_overlap") >= p05_overlap,
        "top1_ok": F.col("top1_agreement") >= top1,
    }
    for name, check in checks.items():
        checked = checked.withColumn(name, check)
    passed = F.col("loss_ok") & F.col("mean_overlap_ok") & F.col("p05_overlap_ok") & F.col("top1_ok")
    return checked.withColumn("status", F.when(passed, "passed").otherwise("failed"))


def ann_recall(exact: DataFrame, approximate: DataFrame, depth: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, query_id, recall): share of the exact first `depth` that the approximate run found.

    `by` columns (for example the search effort) live on the approximate side.
    """
    truth = exact.where(F.col("rank") <= depth).select("query_id", "document_id")
    found = approximate.where(F.col("rank") <= depth).select(*by, "query_id", "document_id")
    hits = found.join(truth, ["query_id", "document_id"], "left_semi").groupBy(*by, "query_id").agg(
        F.count(F.lit(1)).alias("__hits")
    )
    queries = truth.select("query_id").distinct()
    if by:
        queries = queries.join(broadcast_if_small(approximate.select(*by).distinct()))
    return queries.join(hits, [*by, "query_id"], "left").select(
        *by, "query_id", (F.coalesce("__hits", F.lit(0)) / F.lit(float(depth))).alias("recall")
    )


def recall_summary(per_query: DataFrame, floor: float = 0.98, by: Sequence[str] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("recall").alias("mean_recall"),
        F.min("recall").alias("minimum_recall"),
        (F.avg("recall") >= floor).alias("meets_floor"),
    )


def pick_effort(grid: DataFrame, floor: float = 0.98) -> DataFrame:
    """Smallest effort whose recall reaches the floor, else the largest, and whether it passed."""
    passing = F.min(F.when(F.col("recall") >= floor, F.col("effort")))
    return grid.agg(
        F.coalesce(passing, F.max("effort")).alias("effort"),
        passing.isNotNull().alias("meets_floor"),
    )


# -- latency -------------------------------------------------------------------------------------

def latency_summary(samples: DataFrame, by: Sequence[str] = (), value: str = "duration_ms") -> DataFrame:
    """Count, mean, linear p50/p95/p99 and maximum per key."""
    base = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(value).alias("mean"), F.max(value).alias("maximum")
    )
    points = exact_percentiles(samples, by, value, LATENCY_POINTS)
    return base.join(points, list(by)) if by else base.join(F.broadcast(points))


def latency_gate(
    summary: DataFrame, queries: DataFrame, budget_ms: float = 200.0, concurrency: int = 4,
    minimum_queries: int = 500,
) -> DataFrame:
    """p95 at the registered concurrency within budget, measured on enough distinct queries."""
    p95 = summary.where(F.col("concurrency") == concurrency).agg(F.max("p95").alias("p95"))
    distinct = queries.agg(F.count_distinct(squeeze(F.col("query"))).alias("distinct_queries"))
    return p95.join(F.broadcast(distinct)).select(
        "p95", "distinct_queries",
        F.coalesce(F.col("p95") <= budget_ms, F.lit(False)).alias("within_budget"),
        (F.col("distinct_queries") >= minimum_queries).alias("enough_queries"),
    )


def latency_drift(recorded: DataFrame, live: DataFrame, by: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Relative percentile differences of two summaries against the larger value."""
    names = list(LATENCY_POINTS)
    a = recorded.select(*by, F.col("samples").alias("__n"), *[F.col(p).alias(f"__{p}") for p in names])
    b = live.select(*by, "samples", *names)

    def drift(p: str) -> Column:
        scale = F.greatest(F.col(p), F.col(f"__{p}"))
        return F.when(scale == 0, 0.0).otherwise(F.abs(F.col(p) - F.col(f"__{p}")) / scale)

    joined = a.join(b, list(by)).select(
        *by, (F.col("__n") == F.col("samples")).alias("same_samples"),
        *[drift(p).alias(f"{p}_drift") for p in names],
    )
    worst = F.greatest(*[F.col(f"{p}_drift") for p in names])
    return joined.withColumn("within_limit", F.col("same_samples") & (worst <= limit))


def latency_histogram(
    samples: DataFrame, bounds: Sequence[float], by: Sequence[str] = ("route",),
    value: str = "duration_ms",
) -> DataFrame:
    """(by, bound, cumulative, count, sum): cumulative bucket counts per key.

    All bounds are counted in one aggregate and unfolded afterwards, so rows are not multiplied.
    """
    counted = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"),
        *[F.count_if(F.col(value) <= b).alias(f"__{i}") for i, b in enumerate(bounds)],
    )
    buckets = F.array(
        *[
            F.struct(F.lit(float(b)).alias("bound"), F.col(f"__{i}").alias("cumulative"))
            for i, b in enumerate(bounds)
        ]
    )
    return counted.select(*by, F.inline(buckets), "count", "sum")


# -- ingestion trials ----------------------------------------------------------------------------

def paired_trials(trials: DataFrame) -> DataFrame:
    """Medians per arm, their ratios and the gates of a numeric-versus-base64 comparison.

    Trials are one row per measured build (a handful per arm).
    """
    medians = {
        "bytes": "serialized_bytes", "throughput": "documents_per_second", "p95": "p95_ms",
    }
    arms = ("numeric", "base64")
    row = trials.agg(
        *[F.count_if(F.col("arm") == a).alias(f"{a}_trials") for a in arms],
        *[
            F.percentile(F.when(F.col("arm") == a, F.col(c).cast("double")), 0.5).alias(f"{a}_{m}")
            for a in arms for m, c in medians.items()
        ],
        (F.count_distinct("document_count") == 1).alias("__same"),
        F.bool_and(
            (F.col("failed_items") == 0) & (F.col("vector_count") == F.col("document_count"))
        ).alias("__clean"),
    )
    reduction = 1.0 - F.col("base64_bytes") / F.col("numeric_bytes")
    return (
        row.withColumn("payload_reduction", reduction)
        .withColumn("throughput_ratio", F.col("base64_throughput") / F.col("numeric_throughput"))
        .withColumn("p95_ratio", F.col("base64_p95") / F.col("numeric_p95"))
        .withColumn(
            "complete",
            F.col("__same") & F.col("__clean") & (F.col("numeric_trials") == F.col("base64_trials")),
        )
        .withColumn("payload_ok", F.col("payload_reduction") >= 0.60)
        .withColumn("throughput_ok", F.col("throughput_ratio") >= 0.95)
        .withColumn("p95_ok", F.col("p95_ratio") <= 1.05)
        .drop("__same", "__clean")
    )


def payload_sizes(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Per row: characters of the numeric JSON array and of the base64 form."""
    from rankmill.functions.vectors import base64_length

    numeric = F.length(F.to_json(vector))
    return vectors.select(
        key, numeric.cast("long").alias("numeric_bytes"),
        base64_length(F.size(vector)).alias("base64_bytes"),
    )


def replay_faults(
    stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], rtol: float = 1e-4, atol: float = 1e-5
) -> DataFrame:
    """(keys, fault) where a re-scored sample disagrees with the stored values.

    `values` is an array of doubles on both sides (a vector, one pair score, or the weights of a
    token map in token order).
    """
    a = stored.select(*keys, F.col("values").alias("__a"))
    b = recomputed.select(*keys, F.col("values").alias("__b"))
    close = F.forall(
        F.zip_with("__a", "__b", lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(x)),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    fault = (
        F.when(F.col("__b").isNull(), "not_recomputed")
        .when(F.col("__a").isNull(), "not_stored")
        .when(F.size("__a") != F.size("__b"), "length")
        .when(~close, "value")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, fault.alias("fault")).where(
        F.col("fault").isNotNull()
    )
