"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from rankmill.llm.centroids import SQL as CENTROID_SQL
from rankmill.llm.common import small_batches, table
from rankmill.llm.filter_audit import SQL as AUDIT_SQL
from rankmill.llm.line_runs import SQL as LINE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.simhash import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.repeats import repeated_windows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_windows(docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.langid import identify

    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.secret_scan import digest, scan, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs, train(docs)))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.html_main import extract, train

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.vector_graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.line_runs import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


ORACLES["op8_line_dedup"] = LINE_SQL.format(documents="documents")


#: Vocabulary file of the piece queries.
PIECE_MODEL = os.environ.get("RANKMILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.pieces import decoded, encode, model

    held = model(spark, PIECE_MODEL)
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), held)
    same = decoded(held)("piece_ids").eqNullSafe(F.col("text"))
    return rows.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids", same.alias("round_trip"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.quality import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.filter_audit import audit, failure_sets

    return audit(failure_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLES["op11_filter_audit"] = AUDIT_SQL.format(documents="documents", labels="labels")


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ORACLES["op12_centroid_clustering"] = CENTROID_SQL.format(embeddings="embeddings")


@query
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankmill.llm.pii import digest, scan, train

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs, train(docs)))
