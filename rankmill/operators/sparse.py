"""Learned-sparse retrieval over token-weight maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions.topk import SCHEMA, LocalTopK
from rankmill.operators.joins import skew_safe_join
from rankmill.operators.ordering import score_order, top_k
from rankmill.session import broadcast_if_small, cut_lineage

#: Query tokens that every task may hold, and cells of its matrix of tokens and queries; larger sets take the join.
HELD_TOKENS = 200_000
HELD_CELLS = 4_000_000
#: Most rows that a task keeps, a k-best list for every query.
HELD_BEST = 5_000_000
#: Scores of one block of documents and queries.
BLOCK_SCORES = 2_000_000


def sparse_matches(query_tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, document_id, score): sum of document weights over the query's distinct tokens.

    `query_tokens` is (query_id, token), `vectors` (document_id, embedding map). Vectors are
    placed by document first, so the sums need no further shuffle.
    """
    terms = query_tokens.select("query_id", "token").distinct()
    entries = vectors.select("document_id", "embedding").repartition("document_id").select(
        "document_id", F.explode("embedding").alias("token", "weight")
    )
    return (
        skew_safe_join(entries, terms, ["token"], F.col("document_id"))
        .groupBy("query_id", "document_id")
        .agg(F.sum("weight").alias("score"))
    )


def sparse_search(
    query_tokens: DataFrame, vectors: DataFrame, k: int, decimals: int = 6
) -> DataFrame:
    """The k documents of the highest sums of weights per query.

    Only tokens that some vector has can match. While these and their queries are within HELD_CELLS every task holds
    them, scores its vectors where they lie and keeps k rows per query; no matching pair is exchanged. Larger query
    sets take the join of `sparse_matches`, with the same result.
    """
    terms = query_tokens.select("query_id", "token").distinct()
    known = vectors.select(F.explode(F.map_keys("embedding")).alias("token")).distinct()
    terms = cut_lineage(terms.join(known.join(broadcast_if_small(terms.select("token").distinct()), "token", "left_semi"), "token", "left_semi"))
    rows = terms.limit(HELD_TOKENS + 1).toPandas()  # bounded by HELD_TOKENS
    query, names = pd.factorize(rows["query_id"])
    place, tokens = pd.factorize(rows["token"])
    if len(rows) > HELD_TOKENS or len(names) * len(tokens) > HELD_CELLS or len(names) * k > HELD_BEST:
        scored = sparse_matches(terms, vectors).withColumn("score", F.round("score", decimals))
        return top_k(scored, ["query_id"], score_order(), k)
    asked = np.zeros((len(tokens), len(names)))
    asked[place, query] = 1.0
    held = vectors.sparkSession.sparkContext.broadcast(({x: i for i, x in enumerate(tokens)}, list(names), asked))

    def nearest(batches):
        at, names, asked = held.value
        best = LocalTopK(names, k, decimals)
        size = max(1, BLOCK_SCORES // max(1, len(names), len(at)))
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                weights, there = np.zeros((len(part), len(at))), np.zeros((len(part), len(at)))
                for row, (keys, values) in enumerate(zip(part["tokens"], part["weights"], strict=True)):
                    for token, weight in zip(keys, values, strict=True):
                        column = at.get(token)
                        if column is not None and weight is not None:
                            weights[row, column], there[row, column] = weight, 1.0
                scores = weights @ asked
                matched = scores > 0 if weights.min(initial=0.0) >= 0 and (weights[there > 0] > 0).all() else there @ asked > 0
                best.add(part["document_id"].to_numpy(), np.where(matched, scores, -np.inf))
        yield best.frame()

    entries = vectors.select(
        F.col("document_id").cast("string"), F.map_keys("embedding").alias("tokens"), F.map_values("embedding").alias("weights")
    ).where(F.col("embedding").isNotNull())
    return top_k(entries.mapInPandas(nearest, SCHEMA), ["query_id"], score_order(), k)


def sparse_probe(probes: DataFrame) -> DataFrame:
    """Per probe: shared tokens, and whether it overlaps and finds its expected document.

    Columns: case_id, expected_document_id, hit_ids, sparse_terms, analyzer_terms.
    """
    shared = F.array_sort(F.array_intersect("sparse_terms", "analyzer_terms"))
    return probes.select(
        "case_id",
        shared.alias("overlap"),
        (F.size(shared) > 0).alias("has_overlap"),
        F.array_contains("hit_ids", F.col("expected_document_id")).alias("hit_present"),
    )


def sparse_encode(
    texts: DataFrame, model, ratio: float, key: str = "product_id", text: str = "text",
    batch_size: int = 32,
) -> DataFrame:
    """(key, embedding map): user-supplied `model` maps texts to token-weight dicts; then pruned."""
    from rankmill.functions.sparse import prune_sparse

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                yield pd.DataFrame({key: part[key], "embedding": list(model(list(part[text])))})

    raw = texts.select(key, text).mapInPandas(run, f"{key} string, embedding map<string,double>")
    return raw.select(key, prune_sparse(F.col("embedding"), ratio).alias("embedding"))
