"""Catalogue, judgment, run and vector files. Readers return typed rows; `*_rejects` the bad ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rankmill import schemas
from rankmill.functions.ids import natural_order
from rankmill.functions.text import token_count
from rankmill.functions.vectors import vector_hash


def _tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Tab-separated rows; a header that differs from the schema or a malformed row fails the read."""
    return (
        spark.read.schema(schema)
        .option("sep", "\t").option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").option("encoding", "UTF-8")
        .csv(path)
    )


def _present(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def _finite(name: str) -> Column:
    """Blank or a finite number."""
    number = F.col(name).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return ~_present(name) | F.coalesce(finite, F.lit(False))


_RATINGS = ("rating_count", "average_rating", "review_count")


def _catalog_fault() -> Column:
    return (
        F.when(~_present("product_id"), "product_id")
        .when(~_present("product_name"), "product_name")
        .when(~(_finite("rating_count") & _finite("average_rating") & _finite("review_count")), "number")
    )


def _catalog(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows with their `fault`: the first broken rule, else `duplicate` for an id of several rows."""
    raw = _tsv(spark, path, schemas.PRODUCT_TSV).withColumn("__id", F.trim("product_id"))
    several = raw.where(_present("product_id")).groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    marked = raw.join(several.select("__id", F.lit("duplicate").alias("__again")), "__id", "left")
    return marked.withColumn("fault", F.coalesce(_catalog_fault(), "__again")).drop("__id", "__again")


def read_catalog_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Product rows in the prepared shape; all other rows are in `catalog_rejects`."""
    raw = _catalog(spark, path).where(F.col("fault").isNull())

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    return raw.select(
        text("product_id").alias("product_id"), text("product_name").alias("title"),
        text("product_description").alias("description"),
        text("`category hierarchy`").alias("category"), text("product_class").alias("product_class"),
        F.lit("").alias("brand"), text("product_features").alias("features"),
        *[F.when(_present(c), F.col(c).try_cast("double")).alias(c) for c in _RATINGS],
    )


def catalog_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(product_id, fault): the rows that `read_catalog_tsv` leaves out, each once."""
    return _catalog(spark, path).where(F.col("fault").isNotNull()).select("product_id", "fault")


def _complete(*names: str) -> Column:
    test = _present(names[0])
    for name in names[1:]:
        test = test & _present(name)
    return test


_QUERY, _LABEL = ("query_id", "query"), ("id", "query_id", "product_id", "label")


def read_query_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Complete query rows; the others are in `query_rejects`."""
    return _tsv(spark, path, schemas.QUERY_TSV).where(_complete(*_QUERY)).select(
        F.trim("query_id").alias("query_id"), F.trim("query").alias("query"),
        F.trim(F.coalesce("query_class", F.lit(""))).alias("query_class"),
        token_count(F.col("query")).alias("token_count"),
    )


def query_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.QUERY_TSV).where(~_complete(*_QUERY))


def read_label_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Complete label rows; the others are in `label_rejects`."""
    return _tsv(spark, path, schemas.LABEL_TSV).where(_complete(*_LABEL)).select(
        *[F.trim(c).alias(c) for c in ("id", "query_id", "product_id", "label")]
    )


def label_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.LABEL_TSV).where(~_complete(*_LABEL))


# -- collections and topics ----------------------------------------------------------------------

def read_trec_collection(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(product_id, title, description) from `id TAB title TAB text` lines, plain or gzip.

    A gzip file is one split, so its lines are spread out right after the read. Lines without
    three fields or an id are left out; see `collection_rejects`.
    """
    lines = spark.read.text(path)
    lines = lines.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.split("value", "\t", 3)
    return lines.select(parts.alias("p")).where(
        (F.size("p") == 3) & (F.get("p", F.lit(0)) != "")
    ).select(
        F.get("p", F.lit(0)).alias("product_id"), F.get("p", F.lit(1)).alias("title"),
        F.get("p", F.lit(2)).alias("description"),
    )


def collection_rejects(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).where((F.size(parts) != 3) | (F.get(parts, F.lit(0)) == ""))


def _trec_json(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    rows = spark.read.schema(schemas.TREC_JSON).option("mode", "FAILFAST").json(path)
    return rows, _present("docid") & F.col("title").isNotNull() & F.col("text").isNotNull()


def read_trec_json(spark: SparkSession, path: str) -> DataFrame:
    """(product_id, title, description) from JSON lines with docid, title and text.

    Objects that lack one of them are in `trec_json_rejects`.
    """
    rows, complete = _trec_json(spark, path)
    return rows.where(complete).select(
        F.col("docid").alias("product_id"), "title", F.col("text").alias("description")
    )


def trec_json_rejects(spark: SparkSession, path: str) -> DataFrame:
    rows, complete = _trec_json(spark, path)
    return rows.where(~complete)


def read_trec_topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query); blank topics are left out, repeated ones are in `topic_rejects`."""
    rows = _tsv(spark, path, schemas.TOPIC_TSV)
    return rows.where(_present("id") & _present("query")).select(
        F.trim("id").alias("query_id"), F.trim("query").alias("query")
    )


def topic_rejects(spark: SparkSession, path: str) -> DataFrame:
    rows = _tsv(spark, path, schemas.TOPIC_TSV)
    blank = rows.where(~(_present("id") & _present("query"))).select("id", F.lit("blank").alias("fault"))
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return blank.unionByName(repeated.select("id", F.lit("duplicate").alias("fault")))


# -- judgments and runs --------------------------------------------------------------------------

def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def _judgment_line() -> Column:
    return F.coalesce((F.size("f") == 4) & (_field(1) == "0") & _field(3).try_cast("int").isNotNull(), F.lit(False))


def _run_line() -> Column:
    typed = _field(3).try_cast("int").isNotNull() & _field(4).try_cast("double").isNotNull()
    return F.coalesce((F.size("f") == 6) & (_field(1) == "Q0") & typed, F.lit(False))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, document_id, relevance) from `query 0 document gain` lines; others are in `qrels_rejects`."""
    return _fields(spark, path).where(_judgment_line()).select(
        _field(0).alias("query_id"), _field(2).alias("document_id"),
        _field(3).try_cast("int").alias("relevance"),
    )


def qrels_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no judgment: other fields or marker, or a gain that is no integer."""
    return _fields(spark, path).where(~_judgment_line()).select(F.array_join("f", " ").alias("line"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    """Lines in natural (query, document) order, range-partitioned so that files follow it."""
    ordered = qrels.orderBy(*natural_order("query_id"), *natural_order("document_id"))
    ordered.select(
        F.format_string("%s 0 %s %d", "query_id", "document_id", "relevance").alias("value")
    ).write.mode("overwrite").text(path)


@F.pandas_udf(StringType())
def _twelve_digits(score: pd.Series) -> pd.Series:
    """Shortest form with 12 significant digits; the JVM's %g keeps trailing zeros."""
    return score.map(lambda x: f"{x:.12g}")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, document_id, rank, score, tag) from `query Q0 document rank score tag` lines.

    All other lines are in `run_rejects`.
    """
    return _fields(spark, path).where(_run_line()).select(
        _field(0).alias("query_id"), _field(2).alias("document_id"),
        _field(3).try_cast("int").alias("rank"), _field(4).try_cast("double").alias("score"),
        _field(5).alias("tag"),
    )


def run_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no run entry: other fields or marker, or a rank or score that is no number."""
    return _fields(spark, path).where(~_run_line()).select(F.array_join("f", " ").alias("line"))


def write_run(run: DataFrame, path: str) -> None:
    ordered = run.orderBy("query_id", "rank")
    ordered.select(
        F.format_string(
            "%s Q0 %s %d %s %s", "query_id", "document_id", "rank",
            _twelve_digits(F.col("score").cast("double")), "tag",
        ).alias("value")
    ).write.mode("overwrite").text(path)


# -- JSON lines ----------------------------------------------------------------------------------

def read_products_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRODUCT_JSON).option("mode", "FAILFAST").json(path)


def read_queries_jsonl(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(schemas.QUERY_JSON).option("mode", "FAILFAST").json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def write_jsonl(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """One compact JSON object per line, keys in order."""
    lines = rows.select(
        F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"),
        *([F.col(partition_by).alias("part")] if partition_by else []),
    )
    writer = lines.write.mode("overwrite")
    (writer.partitionBy("part") if partition_by else writer).text(path)


# -- vectors -------------------------------------------------------------------------------------

def _sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    parsed = spark.read.text(path).select(
        "value", F.from_json("value", schemas.SPARSE_JSON).alias("r")
    ).select("value", "r.product_id", "r.embedding")
    numbers = F.transform_values("embedding", lambda _, w: w.try_cast("double"))
    usable = F.forall(
        F.map_values("embedding"), lambda w: w.isNotNull() & ~F.isnan(w) & (F.abs(w) < F.lit(float("inf")))
    )
    fault = (
        F.when(~_present("product_id"), "product_id")
        .when(F.col("embedding").isNull() | (F.size("embedding") == 0), "empty")
        .when(~usable, "weight")
    )
    return parsed.withColumn("embedding", numbers).withColumn("fault", fault)


def read_sparse_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(product_id, embedding map<string,double>) of well-formed lines."""
    return _sparse_rows(spark, path).where(F.col("fault").isNull()).select("product_id", "embedding")


def sparse_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _sparse_rows(spark, path).where(F.col("fault").isNotNull()).select(
        F.coalesce("product_id", F.lit("")).alias("product_id"), "fault"
    )


def write_vector_table(vectors: DataFrame, path: str, generator: dict[str, str]) -> str:
    """Vectors with checksum and generator identity, partitioned by the generator's fingerprint.

    `vectors` is (document_id, cache_key, embedding). Returns the fingerprint.
    """
    import hashlib
    import json

    fingerprint = hashlib.sha256(
        json.dumps(generator, separators=(",", ":"), sort_keys=True).encode()
    ).hexdigest()
    vectors.select(
        "document_id", "cache_key", "embedding", F.size("embedding").alias("dims"),
        vector_hash(F.col("embedding")).alias("vector_sha256"),
        *[F.lit(v).alias(f"generator_{k}") for k, v in sorted(generator.items())],
        F.lit(fingerprint).alias("generator"),
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "generator"
    ).parquet(path)
    return fingerprint


def read_vector_table(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """One generator's vectors; `intact` says whether the stored checksum still matches."""
    return spark.read.parquet(path).where(F.col("generator") == fingerprint).withColumn(
        "intact", vector_hash(F.col("embedding")) == F.col("vector_sha256")
    )


# -- outputs -------------------------------------------------------------------------------------

def file_facts(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """One row: records, files and bytes of a written table."""
    rows = spark.read.format(fmt).load(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")
    )
    per_file = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"))
    return per_file.agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("files"), F.sum("s").alias("bytes")
    )
