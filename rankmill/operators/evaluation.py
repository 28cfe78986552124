"""Run and judgment checks, and the retrieval metrics.

`run` is (query_id, document_id, rank, ...), `qrels` (query_id, document_id, relevance). Both may
carry further key columns (system, setting, mapping, view); pass them as `by`.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankmill.operators.ordering import top_k
from rankmill.session import broadcast_if_small

METRICS = ("ndcg@10", "ndcg@50", "recall@100", "mrr_exact@10", "judged@10")


def judged_run(run: DataFrame, qrels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Run rows with their gain; unjudged rows gain zero."""
    keys = [c for c in by if c in qrels.columns] + ["query_id", "document_id"]
    labels = qrels.select(*keys, F.col("relevance").alias("__relevance"))
    return run.join(labels, keys, "left").select(
        run["*"],
        F.coalesce("__relevance", F.lit(0)).alias("gain"),
        F.col("__relevance").isNotNull().alias("judged"),
    )


def judged_only(run: DataFrame, qrels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop unjudged rows and close the gaps in the ranks."""
    keys = [*by, "query_id"]
    kept = run.join(qrels.select("query_id", "document_id"), ["query_id", "document_id"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("rank")))


def _discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(1))


def ideal_gain(qrels: DataFrame, cutoffs: Sequence[int] = (10, 50)) -> DataFrame:
    """Best possible discounted gain per query from all its judgments, and the number of those with a gain.

    Judgments of a query are counted by gain first; equal gains fill a span of places whose discounts are summed beforehand.
    """
    keys = [c for c in qrels.columns if c not in ("document_id", "relevance")]
    gain, count = F.col("relevance"), F.col("__n")
    counts = qrels.groupBy(*keys, "relevance").agg(F.count(F.lit(1)).alias("__n"))
    end = F.sum(count).over(W.partitionBy(*keys).orderBy(gain.desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = [0.0, *accumulate(1.0 / log2(place + 1) for place in range(1, max(cutoffs) + 1))]
    upto = lambda k, place: F.get(F.lit(sums), F.least(F.lit(k), place).cast("int"))
    spans = counts.withColumn("__end", end).withColumn("__start", F.col("__end") - count)
    return spans.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("__start") < k, gain * (upto(k, F.col("__end")) - upto(k, F.col("__start"))))).alias(f"__ideal_{k}") for k in cutoffs],
        F.coalesce(F.sum(F.when(gain > 0, count)), F.lit(0)).alias("__relevant"),
    )


def evaluate(
    run: DataFrame, qrels: DataFrame, by: Sequence[str] = (), exact_gain: int | Column = 2,
    systems: DataFrame | None = None,
) -> DataFrame:
    """One row per (by, query) of the judgments, queries without results included.

    `exact_gain` is a number or an expression over the `by` columns. `systems` lists the `by` keys when
    they are not on the judgments; by default it is taken from the run.
    """
    by = list(by)
    exact = exact_gain if isinstance(exact_gain, Column) else F.lit(exact_gain)
    rows = judged_run(run, qrels, by)
    measured = rows.groupBy(*by, "query_id").agg(*gained(F.col("gain"), F.col("rank"), F.col("judged"), exact))
    return scored(measured, qrels, by, run if systems is None else systems)


def gained(gain: Column, rank: Column, judged: Column, exact: Column) -> list[Column]:
    """Aggregates over the rows of a query that the metrics are made of."""
    value = gain / _discount(rank)
    return [
        F.sum(F.when(rank <= 10, value)).alias("__dcg_10"),
        F.sum(F.when(rank <= 50, value)).alias("__dcg_50"),
        F.count_if((rank <= 100) & (gain > 0)).alias("__found"),
        F.min(F.when((rank <= 10) & judged & (gain == exact), rank)).alias("__first"),
        F.count_if((rank <= 10) & judged).alias("__judged"),
    ]


def scored(measured: DataFrame, qrels: DataFrame, by: Sequence[str], systems: DataFrame) -> DataFrame:
    """Metrics of every (by, query) of the judgments from `gained` of those with results."""
    labels = [c for c in qrels.columns if c not in ("document_id", "relevance")]
    queries = ideal_gain(qrels.select(*labels, "document_id", "relevance")).dropna(subset=labels)
    rest = [c for c in by if c not in labels]
    if rest:
        queries = queries.join(broadcast_if_small(systems.select(*rest).distinct()))
    zero = F.lit(0.0)

    def ratio(top, bottom):
        return F.when(bottom > 0, F.coalesce(top, F.lit(0)) / bottom).otherwise(zero)

    return queries.join(measured, [*by, "query_id"], "left").select(
        *by,
        *[c for c in labels if c not in by],
        ratio(F.col("__dcg_10"), F.col("__ideal_10")).alias("ndcg@10"),
        ratio(F.col("__dcg_50"), F.col("__ideal_50")).alias("ndcg@50"),
        ratio(F.col("__found"), F.col("__relevant")).alias("recall@100"),
        F.coalesce(F.lit(1.0) / F.col("__first"), zero).alias("mrr_exact@10"),
        (F.coalesce(F.col("__judged"), F.lit(0)) / 10.0).alias("judged@10"),
    )


def macro(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric over all judged queries."""
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(f"`{m}`").alias(m) for m in METRICS]
    )


def ndcg(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, value): discounted gain over the ideal of all judgments; 0 without any gain."""
    value = F.col("gain") / _discount(F.col("rank"))
    found = judged_run(run, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum(value).alias("__dcg")
    )
    ideal = ideal_gain(qrels.select("query_id", "document_id", "relevance"), (k,))
    best = F.col(f"__ideal_{k}")
    return ideal.join(found, "query_id", "left").select(
        "query_id",
        F.when(best > 0, F.coalesce("__dcg", F.lit(0.0)) / best).otherwise(0.0).alias("value"),
    )


def recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    wanted = qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("__relevant"))
    found = judged_run(run, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(
        F.count_if(F.col("gain") > 0).alias("__found")
    )
    return wanted.join(found, "query_id", "left").select(
        "query_id",
        F.when(
            F.col("__relevant") > 0, F.coalesce("__found", F.lit(0)) / F.col("__relevant")
        ).otherwise(0.0).alias("value"),
    )


def mrr_exact(run: DataFrame, qrels: DataFrame, k: int, exact_gain: int = 2) -> DataFrame:
    hits = judged_run(run, qrels).where((F.col("rank") <= k) & F.col("judged")).groupBy("query_id").agg(
        F.min(F.when(F.col("gain") == exact_gain, F.col("rank"))).alias("__first")
    )
    return qrels.select("query_id").distinct().join(hits, "query_id", "left").select(
        "query_id", F.coalesce(F.lit(1.0) / F.col("__first"), F.lit(0.0)).alias("value")
    )


def judged_at(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Judged rows among the first k, over k even when fewer rows came back."""
    hits = judged_run(run, qrels).where((F.col("rank") <= k) & F.col("judged")).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("__judged")
    )
    return qrels.select("query_id").distinct().join(hits, "query_id", "left").select(
        "query_id", (F.coalesce("__judged", F.lit(0)) / F.lit(float(k))).alias("value")
    )


# -- checks --------------------------------------------------------------------------------------

def run_faults(run: DataFrame) -> DataFrame:
    """(query_id, fault): ranks below one, duplicate documents, rank gaps, several tags."""
    per_query = run.groupBy("query_id").agg(
        F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("rank").alias("ranks"), F.count_distinct("document_id").alias("documents"),
    )
    faults = F.array(
        F.when(F.col("low") <= 0, F.lit("rank_not_positive")),
        F.when(F.col("documents") < F.col("n"), F.lit("duplicate_document")),
        F.when(
            (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n")), F.lit("rank_gap")
        ),
    )
    tags = run.agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where(
        F.col("a") != F.col("b")
    ).select(F.lit("").alias("query_id"), F.lit("several_tags").alias("fault"))
    return (
        per_query.select("query_id", F.explode(F.array_compact(faults)).alias("fault"))
        .unionByName(tags)
    )


def qrel_faults(qrels: DataFrame) -> DataFrame:
    """(query_id, document_id, fault): repeated pairs and negative gains."""
    pairs = qrels.groupBy("query_id", "document_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("relevance").alias("low")
    )
    faults = F.array(
        F.when(F.col("n") > 1, F.lit("duplicate_pair")),
        F.when(F.col("low") < 0, F.lit("negative_gain")),
    )
    return pairs.select(
        "query_id", "document_id", F.explode(F.array_compact(faults)).alias("fault")
    )


def cross_check(metrics: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(metric, max_delta, agrees) over all pairs of methods; input (method, metric, value)."""
    return metrics.groupBy("metric").agg(
        (F.max("value") - F.min("value")).alias("max_delta")
    ).withColumn("agrees", F.col("max_delta") <= tolerance)


# -- judgment mappings ---------------------------------------------------------------------------

MAPPINGS = ("primary", "strict_binary", "broad_binary")


def map_qrels(qrels: DataFrame, mapping: str, maximum_gain: int) -> DataFrame:
    gain = F.col("relevance")
    mapped = {
        "primary": gain,
        "strict_binary": (gain == maximum_gain).cast("int"),
        "broad_binary": (gain > 0).cast("int"),
    }[mapping]
    if maximum_gain <= 0 or qrels.where(gain == maximum_gain).isEmpty():
        raise ValueError("the declared maximum gain does not occur in the judgments")
    return qrels.withColumn("relevance", mapped)


def mapped_gains(maximum_gain: int) -> dict:
    """The gain in each mapping as a function of the judged gain."""
    return {
        "primary": lambda gain: gain.cast("int"),
        "strict_binary": lambda gain: (gain == maximum_gain).cast("int"),
        "broad_binary": lambda gain: (gain > 0).cast("int"),
    }


def all_mappings(qrels: DataFrame, maximum_gain: int) -> DataFrame:
    """Every mapping at once: (mapping, query_id, document_id, relevance)."""
    entries = [
        F.struct(F.lit(name).alias("mapping"), value(F.col("relevance")).alias("relevance"))
        for name, value in mapped_gains(maximum_gain).items()
    ]
    return qrels.select("query_id", "document_id", F.inline(F.array(*entries)))
