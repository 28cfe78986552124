"""Score fusion, reranking and result pages for all queries at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankmill.operators.ordering import RESULT_DEPTH, score_order, top_k
from rankmill.session import broadcast_if_small

CANDIDATES = 100
CANDIDATE_WEIGHTS = (0.3, 0.7)


def normalized_clauses(clauses: Sequence[DataFrame], depth: int = RESULT_DEPTH) -> DataFrame:
    """(query_id, clause, document_id, value): min-max within each query's top `depth` per clause.

    A clause whose kept scores are all equal normalises to one.
    """
    parts = [
        top_k(c.select("query_id", "document_id", "score"), ["query_id"], score_order(), depth)
        .withColumn("clause", F.lit(i))
        for i, c in enumerate(clauses)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    span = W.partitionBy("query_id", "clause")
    low, high = F.min("score").over(span), F.max("score").over(span)
    return rows.select(
        "query_id", "clause", "document_id",
        F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias("value"),
    )


def check_weights(weights: Sequence[float]) -> list[float]:
    values = [float(w) for w in weights]
    if (
        len(values) < 2
        or any(not math.isfinite(w) or w < 0 for w in values)
        or abs(sum(values) - 1.0) > 1e-12
    ):
        raise ValueError("fusion weights must be finite, non-negative and sum to one")
    return values


def minmax_fuse(
    clauses: Sequence[DataFrame], weights: Sequence[float], k: int = RESULT_DEPTH,
    depth: int = RESULT_DEPTH, decimals: int = 6,
) -> DataFrame:
    """Weighted mean of the normalised clause scores; a clause without the document counts zero."""
    grid = minmax_grid(clauses, {"only": weights}, k, depth, decimals)
    return grid.drop("setting")


def minmax_grid(
    clauses: Sequence[DataFrame], settings: dict[str, Sequence[float]], k: int = RESULT_DEPTH,
    depth: int = RESULT_DEPTH, decimals: int = 6,
) -> DataFrame:
    """(setting, query_id, document_id, rank, score) for several weightings in one pass.

    Clause scores are computed and aligned once per (query, document); the settings are an
    array of constants exploded afterwards.
    """
    checked = {name: check_weights(w) for name, w in settings.items()}
    aligned = normalized_clauses(clauses, depth).groupBy("query_id", "document_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("clause") == i, F.col("value"))), F.lit(0.0)).alias(f"__{i}")
            for i in range(len(clauses))
        ]
    )
    entries = []
    for name, weights in checked.items():
        total = F.lit(0.0)
        for i, weight in enumerate(weights):
            total = total + F.lit(weight) * F.col(f"__{i}")
        entries.append(
            F.struct(F.lit(name).alias("setting"), F.round(total, decimals).alias("score"))
        )
    spread = aligned.select("query_id", "document_id", F.inline(F.array(*entries)))
    return top_k(spread, ["setting", "query_id"], score_order(), k)


def rrf_fuse(
    runs: Sequence[DataFrame], rank_constant: int = 60, k: int = RESULT_DEPTH, decimals: int = 9
) -> DataFrame:
    """Sum of 1 / (constant + rank) over the runs that contain the document."""
    if isinstance(rank_constant, bool) or rank_constant < 1:
        raise ValueError("the rank constant must be an integer of at least one")
    rows = runs[0].select("query_id", "document_id", "rank")
    for run in runs[1:]:
        rows = rows.unionByName(run.select("query_id", "document_id", "rank"))
    fused = rows.groupBy("query_id", "document_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.col("rank") + rank_constant)), decimals).alias("score")
    )
    return top_k(fused, ["query_id"], score_order(), k)


def candidate_rerank(
    candidates: DataFrame, dense: DataFrame, weights: Sequence[float] = CANDIDATE_WEIGHTS,
    decimals: int = 6,
) -> DataFrame:
    """Fuse the first 100 lexical candidates with their own vector scores; nothing else enters.

    `dense` holds vector scores of candidate pairs (`dense.candidate_scores`).
    """
    kept = top_k(candidates, ["query_id"], score_order(), CANDIDATES)
    own = dense.join(kept.select("query_id", "document_id"), ["query_id", "document_id"], "left_semi")
    return minmax_fuse([kept, own], weights, CANDIDATES, CANDIDATES, decimals)


def universe_faults(candidates: DataFrame, fused: DataFrame) -> DataFrame:
    """(query_id, document_id, fault) wherever the fused list is not the candidates, once each."""
    left = candidates.groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("__c"))
    right = fused.groupBy("query_id", "document_id").agg(
        F.count(F.lit(1)).alias("__f"),
        F.min(
            F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= 0)
            & (F.col("score") < F.lit(float("inf")))
        ).alias("__ok"),
    )
    fault = (
        F.when(F.col("__f").isNull(), "missing")
        .when(F.col("__c").isNull(), "unexpected")
        .when((F.col("__f") > 1) | (F.col("__c") > 1), "duplicate")
        .when(~F.col("__ok"), "bad_score")
    )
    return (
        left.join(right, ["query_id", "document_id"], "full_outer")
        .select("query_id", "document_id", fault.alias("fault"))
        .where(F.col("fault").isNotNull())
    )


def salable_first(results: DataFrame, availability: DataFrame) -> DataFrame:
    """Available documents keep their order before the unavailable ones."""
    joined = results.join(availability.select("document_id", "is_salable"), "document_id")
    window = W.partitionBy("query_id").orderBy(F.col("is_salable").desc(), "rank")
    return joined.withColumn("rank", F.row_number().over(window))


def candidate_depth(start: Column, size: Column) -> Column:
    """How many lexical candidates a page request reads: at least 100, at most 199."""
    end = F.greatest(F.lit(0), start) + F.greatest(F.lit(0), size)
    return F.greatest(F.lit(CANDIDATES), F.least(F.lit(199), end))


def page(reranked: DataFrame, native: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, document_id, position) of each request's page.

    The reranked candidates come first, then the native list from position 100 on. `requests` is
    (query_id, start, size).
    """
    wanted = broadcast_if_small(requests)
    end = candidate_depth(F.col("start"), F.col("size"))
    head = reranked.select("query_id", "document_id", "rank").join(wanted, "query_id")
    tail = native.where(F.col("rank") > CANDIDATES).select("query_id", "document_id", "rank").join(
        wanted, "query_id"
    ).where(F.col("rank") <= end)
    position = F.row_number().over(W.partitionBy("query_id").orderBy("__part", "rank"))
    together = head.withColumn("__part", F.lit(0)).unionByName(tail.withColumn("__part", F.lit(1)))
    return (
        together.withColumn("position", position)
        .where(
            (F.col("position") > F.col("start"))
            & (F.col("position") <= F.col("start") + F.col("size"))
        )
        .select("query_id", "document_id", "position")
    )


def guarded_search(
    routes: DataFrame, lexical: DataFrame, fused: DataFrame
) -> DataFrame:
    """Known-item queries keep the lexical list, all others take the fused one."""
    direct = lexical.join(
        routes.where(F.col("route") != "hybrid").select("query_id", "route"), "query_id"
    )
    mixed = fused.join(
        routes.where(F.col("route") == "hybrid").select("query_id", "route"), "query_id"
    )
    columns = ["query_id", "document_id", "rank", "score", "route"]
    return direct.select(*columns).unionByName(mixed.select(*columns))


# -- pair reranking ------------------------------------------------------------------------------

def rerank(
    run: DataFrame, pair_scores: DataFrame, depth: int = 50, result_depth: int = RESULT_DEPTH,
    tag: str = "reranked",
) -> DataFrame:
    """Reorder the first `depth` rows by pair score, old rank, id; the rest stays in place."""
    scores = pair_scores.select("query_id", "document_id", F.col("score").alias("__pair"))
    joined = run.join(scores, ["query_id", "document_id"], "left")
    tail = (F.col("rank") > depth).cast("int")
    window = W.partitionBy("query_id").orderBy(
        tail, F.when(tail == 0, -F.col("__pair")), "rank", "document_id"
    )
    return joined.withColumn("__new", F.row_number().over(window)).select(
        "query_id", "document_id", F.col("__new").alias("rank"),
        (F.lit(result_depth) - F.col("__new") + 1).cast("double").alias("score"),
        F.lit(tag).alias("tag"),
    )


def rerank_pairs(
    runs: DataFrame, queries: DataFrame, documents: DataFrame, depth: int = 50
) -> DataFrame:
    """Distinct (query, document) texts to score within the first `depth` of any run.

    Rows whose query or document is unknown belong to `unknown_pairs`.
    """
    head = runs.where(F.col("rank") <= depth).select("query_id", "document_id").distinct()
    return (
        head.join(queries.select("query_id", "query"), "query_id")
        .join(documents.select("document_id", "document"), "document_id")
        .select("query", "document")
        .distinct()
    )


def unknown_pairs(runs: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Run rows that reference no known query or document."""
    pairs = runs.select("query_id", "document_id").distinct()
    no_query = pairs.join(queries.select("query_id"), "query_id", "left_anti")
    no_document = pairs.join(documents.select("document_id"), "document_id", "left_anti")
    columns = ["query_id", "document_id"]
    return (
        no_query.select(*columns, F.lit("query").alias("unknown"))
        .unionByName(no_document.select(*columns, F.lit("document").alias("unknown")))
    )


def score_pairs(pairs: DataFrame, model, batch_size: int = 64) -> DataFrame:
    """(query, document, score); `model` maps a list of (query, document) texts to scores."""

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                texts = list(zip(part["query"], part["document"]))
                yield pd.DataFrame(
                    {"query": part["query"], "document": part["document"], "score": list(model(texts))}
                )

    return pairs.select("query", "document").distinct().mapInPandas(
        run, "query string, document string, score double"
    )
