"""Paired comparisons of runs, corrected for several candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankmill.functions.special import sign_p_value, t_p_value
from rankmill.operators.evaluation import all_mappings, gained, mapped_gains, scored
from rankmill.operators.evaluation import macro as macro_mean
from rankmill.session import broadcast_if_small

ALPHA = 0.05
MINIMUM_DELTA = 0.02


def paired_deltas(
    metrics: DataFrame, baseline: str, by: Sequence[str] = (), metric: str = "value"
) -> DataFrame:
    """(by, system, query_id, delta, baseline_value): every candidate against the baseline."""
    base = metrics.where(F.col("system") == baseline).select(
        *by, "query_id", F.col(metric).alias("baseline_value")
    )
    return (
        metrics.where(F.col("system") != baseline)
        .select(*by, "system", "query_id", F.col(metric).alias("__value"))
        .join(base, [*by, "query_id"])
        .select(
            *by, "system", "query_id", "baseline_value",
            (F.col("__value") - F.col("baseline_value")).alias("delta"),
        )
    )


def paired_t(deltas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided paired Student test and win/tie/loss counts per (by, system).

    Identical runs have no spread: their p-value is one.
    """
    n, mean, spread = F.col("queries"), F.col("mean_delta"), F.col("__spread")
    summary = deltas.groupBy(*by, "system").agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("baseline_value").alias("baseline_score"),
        F.avg("delta").alias("mean_delta"),
        F.stddev_samp("delta").alias("__spread"),
        F.count_if(F.col("delta") > 0).alias("wins"),
        F.count_if(F.col("delta") == 0).alias("ties"),
        F.count_if(F.col("delta") < 0).alias("losses"),
    )
    t = F.when(spread > 0, mean / (spread / F.sqrt(n)))
    p = F.when(spread > 0, t_p_value(F.col("t"), (n - 1).cast("double"))).otherwise(
        F.when(mean == 0, 1.0).otherwise(0.0)
    )
    return summary.withColumn("t", t).withColumn("p_value", p).drop("__spread")


def holm(p_values: DataFrame, by: Sequence[str] = (), name: str = "system") -> DataFrame:
    """Step-down adjusted p-values within each family; families hold one row per candidate."""
    order = W.partitionBy(*by).orderBy("p_value", name)
    size = F.count(F.lit(1)).over(W.partitionBy(*by))
    step = F.least(
        F.lit(1.0), F.col("p_value") * (size - F.row_number().over(order) + 1)
    )
    return p_values.withColumn("__step", step).withColumn(
        "adjusted_p_value",
        F.max("__step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
    ).drop("__step")


def gate(
    comparisons: DataFrame, alpha: float = ALPHA, minimum_delta: float = MINIMUM_DELTA,
    eligible: bool | Column = True,
) -> DataFrame:
    """Significance and effect-size decision with its text outcome."""
    eligible = F.lit(eligible) if isinstance(eligible, bool) else eligible
    significant = F.col("adjusted_p_value") <= alpha
    enough = F.col("mean_delta") >= minimum_delta
    return (
        comparisons.withColumn("significant", significant)
        .withColumn("meets_delta", enough)
        .withColumn("supports", F.col("significant") & F.col("meets_delta"))
        .withColumn(
            "interpretation",
            F.when(F.col("supports") & eligible, "passes_quality_significance_gate")
            .when(F.col("supports"), "provisional_only_ineligible_evidence")
            .otherwise("does_not_pass_quality_significance_gate"),
        )
    )


def compare_family(
    metrics: DataFrame, baseline: str, by: Sequence[str] = (), metric: str = "value",
    alpha: float = ALPHA, minimum_delta: float = MINIMUM_DELTA,
) -> DataFrame:
    """Per-query metrics of several systems to gated, corrected comparisons per family."""
    tested = paired_t(paired_deltas(metrics, baseline, by, metric), by)
    return gate(holm(tested, by), alpha, minimum_delta)


def family_eligible(sources: DataFrame, by: Sequence[str] = ("family",)) -> DataFrame:
    """A family counts only if every source flag is literally true; names those that are not.

    Sources per family are a handful of registered names.
    """
    good = F.col("eligible").eqNullSafe(True)
    return sources.groupBy(*by).agg(
        F.bool_and(good).alias("eligible_for_decision"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(~good, F.col("source")))), ","
        ).alias("reasons"),
    )


def compare_families(
    metrics: DataFrame, baseline: str, by: Sequence[str], sources: DataFrame, metric: str = "value",
    alpha: float = ALPHA, minimum_delta: float = MINIMUM_DELTA,
) -> DataFrame:
    """Gated comparisons of all families in one job: corrected within each family, decided only on eligible evidence.

    `sources` is (by..., source, eligible); a family without sources is not eligible.
    """
    tested = holm(paired_t(paired_deltas(metrics, baseline, by, metric), by), by)
    flags = broadcast_if_small(family_eligible(sources, by))
    return gate(tested.join(flags, list(by), "left"), alpha, minimum_delta, F.coalesce("eligible_for_decision", F.lit(False)))


def sign_test(
    scores: DataFrame, maximum_regression: float = 0.01, alpha: float = ALPHA
) -> DataFrame:
    """One-sided exact sign test that the candidate is worse; input (query_id, baseline, candidate)."""
    delta = F.col("candidate") - F.col("baseline")
    summary = scores.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("baseline").alias("baseline_mrr"),
        F.avg("candidate").alias("candidate_mrr"),
        F.avg(delta).alias("mean_delta"),
        F.count_if(delta > 0).alias("wins"),
        F.count_if(delta == 0).alias("ties"),
        F.count_if(delta < 0).alias("losses"),
    ).withColumn("p_value", sign_p_value(F.col("losses"), F.col("wins") + F.col("losses")))
    regression = (F.col("mean_delta") < 0) & (F.col("p_value") <= alpha)
    within = F.col("mean_delta") >= -maximum_regression
    return summary.withColumn("significant_regression", regression).withColumn(
        "within_margin", within
    ).withColumn("passes", F.col("within_margin") & ~F.col("significant_regression"))


# -- robustness ----------------------------------------------------------------------------------

def robustness_metrics(runs: DataFrame, qrels: DataFrame, maximum_gain: int) -> DataFrame:
    """Per-query metrics for every relevance mapping and both views (all rows, judged rows only).

    `runs` carries a `system` column. Every row meets its judgment once; gains of all mappings and ranks of both views
    are expressions over it, summed up in one pass.
    """
    labels = qrels.select("query_id", "document_id", F.col("relevance").alias("__relevance"), F.lit(True).alias("__there"))
    rows = runs.select("system", "query_id", "document_id", "rank").join(labels, ["query_id", "document_id"], "left").repartition("system", "query_id")
    there, gain = F.col("__there").isNotNull(), F.col("__relevance")
    # equal ranks of different documents count one by one, a document that is judged twice once
    place = F.dense_rank().over(W.partitionBy("system", "query_id", "__there").orderBy("rank", "document_id"))
    rows = rows.withColumn("__place", F.when(there, place))
    cells = []
    for name, value in mapped_gains(maximum_gain).items():
        for view, rank in (("full_corpus", "rank"), ("rerank_within_judged", "__place")):
            exact = F.lit(maximum_gain if name == "primary" else 1)
            sums = gained(F.coalesce(value(gain), F.lit(0)), F.col(rank), gain.isNotNull(), exact)
            cells.append((name, view, F.struct(*sums).alias(f"__{name}_{view}"), F.count(rank).alias(f"__rows_{name}_{view}")))
    summed = rows.groupBy("system", "query_id").agg(*[x for _, _, *aggregates in cells for x in aggregates])
    listed = F.array(*[
        F.when(F.col(f"__rows_{m}_{v}") > 0, F.struct(F.lit(m).alias("mapping"), F.lit(v).alias("view"), F.col(f"__{m}_{v}").alias("sums"))) for m, v, *_ in cells
    ])
    measured = summed.select("system", "query_id", F.explode(F.array_compact(listed)).alias("c")).select("c.mapping", "c.view", "system", "query_id", "c.sums.*")
    views = F.explode(F.array(F.lit("full_corpus"), F.lit("rerank_within_judged"))).alias("view")
    names = runs.select("system").distinct().select(views, "system")
    return scored(measured, all_mappings(qrels, maximum_gain), ["mapping", "view", "system"], names)


def robustness_grid(
    runs: DataFrame, qrels: DataFrame, baseline: str, maximum_gain: int, metric: str = "ndcg@10"
) -> DataFrame:
    """Gated comparisons per (mapping, view) with the macro metrics of each candidate."""
    by = ["mapping", "view"]
    measured = robustness_metrics(runs, qrels, maximum_gain).withColumn("value", F.col(f"`{metric}`"))
    compared = compare_family(measured, baseline, by)
    return compared.join(macro_mean(measured, [*by, "system"]).drop("queries"), [*by, "system"])


def conclusion_holds(grid: DataFrame) -> DataFrame:
    """Per candidate: whether the gate holds in every mapping and view."""
    return grid.groupBy("system").agg(
        F.count(F.lit(1)).alias("cells"), F.bool_and("supports").alias("holds")
    )
