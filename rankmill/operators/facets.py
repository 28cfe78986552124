"""Facet counts over documents and over result sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions.row_scores import QueryWords
from rankmill.operators.lexical import ROW_ENTRIES, matching_pairs
from rankmill.operators.ordering import top_k
from rankmill.session import cut_lineage

FACET_FIELDS = ("brand", "category", "product_class")
FACET_SIZE = 20


def facets(
    rows: DataFrame, fields: Sequence[str] = FACET_FIELDS, by: Sequence[str] = (),
    size: int = FACET_SIZE,
) -> DataFrame:
    """(by, field, key, documents, place): most frequent values, ties by key."""
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields]
    )
    counts = (
        rows.select(*by, F.inline(entries))
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy(*by, "field", "key")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
    return top_k(counts, [*by, "field"], [F.col("documents").desc(), F.col("key")], size, "place")


def top_category(rows: DataFrame, field: str = "category") -> DataFrame:
    """One row: the value with the most documents."""
    return (
        rows.where(F.col(field).isNotNull() & (F.col(field) != ""))
        .groupBy(F.col(field).alias("value"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.col("__n").desc(), "value").limit(1).select("value")
    )


def lexical_facet_counts(
    texts: DataFrame, terms: DataFrame, search_fields: Sequence[str], filter_value: str | None,
    fields: Sequence[str] = FACET_FIELDS, filter_field: str = "category",
) -> DataFrame:
    """(query_id, state, field, key, documents) of all documents that share a word with the query.

    `texts` is `document_texts` with the facet columns kept. The match set of a query stays in the task that reads
    the documents: only counts per value leave it. The field "" counts the hits. State "filtered" counts the
    documents whose `filter_field` is `filter_value`.
    """
    wanted = terms.withColumn("field", F.explode(F.array(*[F.lit(f) for f in search_fields])))
    found = wanted.limit(ROW_ENTRIES + 1).toPandas()
    schema = "query_id string, state string, field string, key string, documents bigint"
    keys = F.array(F.lit(""), *[F.col(f).cast("string") for f in fields])
    rows = texts.select(
        "document_id", F.col("fields.field").alias("names"), F.col("fields.words").alias("words"),
        keys.alias("keys"), (F.col(filter_field).eqNullSafe(F.lit(filter_value))).alias("inside"),
    )
    if len(found) > ROW_ENTRIES:  # too many query words for a task: pairs by a join, then the same counts
        pairs = matching_pairs(texts, terms, search_fields).select("query_id", "document_id").distinct()
        named = F.arrays_zip(F.array(F.lit(""), *[F.lit(f) for f in fields]).alias("field"), F.col("keys").alias("key"))
        states = F.when(F.col("inside"), F.array(F.lit("unfiltered"), F.lit("filtered"))).otherwise(F.array(F.lit("unfiltered")))
        counted = pairs.join(rows.drop("names", "words"), "document_id").select("query_id", F.explode(states).alias("state"), F.explode(named).alias("x"))
        parts = counted.select("query_id", "state", "x.field", "x.key", F.lit(1).cast("bigint").alias("documents"))
    else:
        shared = texts.sparkSession.sparkContext.broadcast(found)
        labels = ["", *fields]

        def count(batches):
            held = QueryWords(shared.value)
            for batch in batches if len(held.query_ids) else ():
                document = np.repeat(np.arange(len(batch)), batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
                values = batch.column("keys").flatten().dictionary_encode()
                key = values.indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, len(labels))
                inside = batch.column("inside").to_numpy(zero_copy_only=False)
                pairs = [document[r] * len(held.query_ids) + q for r, q, *_ in held.pairs(batch.column("names").flatten(), batch.column("words").flatten(), None, False)]
                pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                doc, query = pair // len(held.query_ids), pair % len(held.query_ids)
                width = len(values.dictionary) + 1
                for place, label in enumerate(labels):
                    for state, some in (("unfiltered", np.ones(len(doc), bool)), ("filtered", inside[doc])):
                        codes, number = np.unique((query * width + key[doc, place] + 1)[some], return_counts=True)
                        names = [values.dictionary[k - 1].as_py() if k else None for k in (codes % width).tolist()]
                        yield pd.DataFrame({
                            "query_id": pd.Series(held.query_ids[codes // width], dtype=object), "state": state, "field": label,
                            "key": pd.Series(names, dtype=object), "documents": number,
                        })

        def arrow(batches):
            kinds = pa.schema([("query_id", pa.string()), ("state", pa.string()), ("field", pa.string()), ("key", pa.string()), ("documents", pa.int64())])
            for part in count(batches):
                yield pa.RecordBatch.from_pandas(part, kinds, preserve_index=False)

        parts = rows.drop("document_id").mapInArrow(arrow, schema)
    return parts.groupBy("query_id", "state", "field", "key").agg(F.sum("documents").alias("documents"))


def facet_compare(
    texts: DataFrame, terms: DataFrame, search_fields: Sequence[str], fused: DataFrame, documents: DataFrame,
    fields: Sequence[str] = FACET_FIELDS, filter_field: str = "category",
) -> DataFrame:
    """Facets of the lexical matches and of the fused list, plain and under the top category.

    `texts` and `terms` give the matches (`lexical_facet_counts`), `fused` is (query_id, document_id). One row per
    (query, leg, filter state, field, key) with the total hits of its leg.
    """
    top = top_category(documents, filter_field).head()
    value = top["value"] if top else None
    lexical = lexical_facet_counts(texts, terms, search_fields, value, fields, filter_field).withColumn("leg", F.lit("lexical"))
    named = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("key")), *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields])
    states = F.when(F.col(filter_field).eqNullSafe(F.lit(value)), F.array(F.lit("unfiltered"), F.lit("filtered"))).otherwise(F.array(F.lit("unfiltered")))
    few = fused.select("query_id", "document_id").join(documents.select("document_id", *fields), "document_id")
    listed = few.withColumn("state", F.explode(states)).select("query_id", "state", F.inline(named)).groupBy("query_id", "state", "field", "key").agg(
        F.count(F.lit(1)).alias("documents")
    )
    counts = cut_lineage(lexical.unionByName(listed.withColumn("leg", F.lit("fused"))))
    by = ["query_id", "leg", "state"]
    totals = counts.where(F.col("field") == "").select(*by, F.col("documents").alias("total_hits"))
    values = counts.where((F.col("field") != "") & F.col("key").isNotNull() & (F.col("key") != ""))
    return top_k(values, [*by, "field"], [F.col("documents").desc(), F.col("key")], FACET_SIZE, "place").join(totals, by)
