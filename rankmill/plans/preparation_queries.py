"""Judgment and catalogue preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.operators import dense as dn
from rankmill.operators import documents as dx
from rankmill.operators import preparation as pp
from rankmill.operators.ordering import spanning_sample
from rankmill.plans.oracle import nat, squeeze, with_
from rankmill.plans.lexical_queries import with_more
from rankmill.plans.registry import query


@query("q01_aggregate_labels", "query_id:s document_id:s relevance:i", with_("judgments", "SELECT * FROM judgments"))
def _(t):
    return t.judgments


_PAIRS = "SELECT query_id, product_id, count(*) AS n, count(DISTINCT gain) AS g FROM judgments_raw GROUP BY 1, 2"


@query(
    "q02_label_audit", "raw_judgments:i unique_pairs:i duplicate_pairs:i duplicate_rows:i conflicting_pairs:i exact_labels:i partial_labels:i irrelevant_labels:i",
    with_("judgments_raw", "SELECT sum(n) AS raw_judgments, count(*) AS unique_pairs, count(*) FILTER (n > 1) AS duplicate_pairs, sum(n) - count(*) AS duplicate_rows, count(*) FILTER (g > 1) AS conflicting_pairs, "
          "(SELECT count(*) FROM judgments_raw WHERE gain = 2) AS exact_labels, (SELECT count(*) FROM judgments_raw WHERE gain = 1) AS partial_labels, (SELECT count(*) FROM judgments_raw WHERE gain = 0) AS irrelevant_labels FROM (" + _PAIRS + ")"),
)
def _(t):
    return pp.label_audit(t.judgments_raw)


@query(
    "q03_label_conflicts", "query_id:s product_id:s l_orderkey:i l_linenumber:i label:s chosen_gain:i",
    with_("judgments_raw", "SELECT query_id, product_id, l_orderkey, l_linenumber, label, chosen_gain FROM (SELECT *, max(gain) OVER p <> min(gain) OVER p AS conflict FROM judgments_raw WINDOW p AS (PARTITION BY query_id, product_id)) JOIN ("
          "SELECT query_id, product_id, gain AS chosen_gain FROM (SELECT query_id, product_id, gain, count(*) AS v FROM judgments_raw GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY v DESC, gain) = 1) USING (query_id, product_id) WHERE conflict"),
)
def _(t):
    return pp.label_conflicts(t.judgments_raw)


@query(
    "q04_product_audit", "products:i duplicate_ids:i blank_id:i blank_title:i missing_brand:i missing_features:i bad_price:i",
    "SELECT count(*) AS products, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids, 0 AS blank_id, count(*) FILTER (p_type = 'SMALL') AS blank_title, "
    "count(*) FILTER (p_size % 5 = 0) AS missing_brand, count(*) FILTER (p_size % 3 = 0) AS missing_features, count(*) FILTER (p_size % 8 = 1) AS bad_price FROM part",
)
def _(t):
    spoiled = t.products.select(
        F.col("title").alias("product_id"),
        F.when(F.col("product_class") == "SMALL", "  ").otherwise(F.col("title")).alias("title"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("brand")).alias("brand"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("features")).alias("features"),
        F.when(F.col("p_size") % 8 == 1, "n/a").otherwise(F.col("price").cast("string")).alias("price"),
    )
    return pp.product_audit(spoiled, ["brand", "features"], ["price"])


@query(
    "q05_orphans", "query_id:s product_id:s label:s missing:s",
    with_("judgments_raw", "SELECT query_id, product_id, label, 'query' AS missing FROM judgments_raw WHERE query_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) "
          "UNION ALL SELECT query_id, product_id, label, 'product' FROM judgments_raw WHERE product_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <> 7)"),
)
def _(t):
    queries = t.raw("supplier").where("s_acctbal > 0").selectExpr("cast(s_suppkey as string) query_id")
    return pp.orphans(t.judgments_raw.select("query_id", "product_id", "label"), queries, t.products.where("p_size <> 7"))


@query(
    "q05_orphan_rate", "judgments:i orphan_judgments:i orphan_products:i orphan_rate:f9 within_limit:b",
    with_("judgments_raw products", "SELECT *, orphan_judgments / judgments AS orphan_rate, orphan_judgments / judgments <= 0.01 AS within_limit FROM (SELECT count(*) AS judgments, count(*) FILTER (p.product_id IS NULL) AS orphan_judgments, "
          "count(DISTINCT CASE WHEN p.product_id IS NULL THEN j.product_id END) AS orphan_products FROM judgments_raw j LEFT JOIN (SELECT product_id FROM products WHERE p_size <> 7) p ON p.product_id = j.product_id)"),
)
def _(t):
    return pp.orphan_rate(t.judgments_raw, t.products.where("p_size <> 7"))


@query(
    "f08_invalid_labels", "query_id:s product_id:s fault:s",
    with_("judgments_raw", "SELECT query_id, product_id, CASE WHEN label = 'Partial' THEN 'unknown_label' ELSE 'unknown_query' END AS fault FROM judgments_raw "
          "WHERE label = 'Partial' OR query_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)"),
)
def _(t):
    renamed = t.judgments_raw.withColumn("label", F.when(F.col("label") == "Partial", "Maybe").otherwise(F.col("label")))
    queries = t.raw("supplier").where("s_acctbal > 0").selectExpr("cast(s_suppkey as string) query_id")
    return pp.invalid_labels(renamed, queries)


@query(
    "q06_hash_split", "query_id:s split:s",
    "SELECT query_id, CASE WHEN place <= n // 2 THEN 'dev' ELSE 'test' END AS split FROM (SELECT query_id, row_number() OVER (ORDER BY sha256('seed-1' || chr(0) || query_id), " + nat("query_id") + ") AS place, count(*) OVER () AS n FROM (SELECT CAST(c_custkey AS VARCHAR) AS query_id FROM customer))",
)
def _(t):
    return pp.hash_split(t.raw("customer").selectExpr("cast(c_custkey as string) query_id"), "seed-1")


@query(
    "q07_known_item_sample", "query_id:s query:s kind:s expected_document_id:s relevance:i",
    with_("products", "SELECT printf('sku-%03d', row_number() OVER (ORDER BY k)) AS query_id, 'RW-' || product_id AS query, 'synthetic_sku' AS kind, product_id AS expected_document_id, 2 AS relevance FROM (SELECT product_id, sha256('s:sku:' || product_id) AS k FROM products ORDER BY k LIMIT 50) "
          f"UNION ALL SELECT printf('title-%03d', row_number() OVER (ORDER BY k)), title, 'exact_title', product_id, 2 FROM (SELECT * FROM (SELECT product_id, trim(title) AS title, sha256('s:title:' || product_id) AS k, row_number() OVER (PARTITION BY {squeeze('title')} ORDER BY sha256('s:title:' || product_id)) AS place FROM products) WHERE place = 1 ORDER BY k LIMIT 50)"),
)
def _(t):
    return pp.known_item_sample(t.products, "s", 50, 50, "RW")


@query("q08_self_retrieval_sample", "document_id:s",
       f"SELECT document_id FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents) ORDER BY sha256('sample:' || document_id), {nat('document_id')} LIMIT 100")
def _(t):
    return pp.hash_sample(t.docs, "document_id", "sample:", 100)


@query("q09_spanning_sample", "position:i document_id:s",
       f"SELECT p AS position, document_id FROM (SELECT *, row_number() OVER (ORDER BY {nat('document_id')}) - 1 AS p, count(*) OVER () AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents)) WHERE p IN (SELECT i * (n - 1) // 63 FROM range(64) r(i))")
def _(t):
    from rankmill.functions.ids import natural_order

    return spanning_sample(t.docs.select("document_id"), natural_order("document_id"), 64)


@query("q10_clip_gains", "query_id:s document_id:s relevance:i clipped:b",
       with_("judgments", "SELECT query_id, document_id, greatest(relevance - 1, 0) AS relevance, relevance = 0 AS clipped FROM judgments"))
def _(t):
    return pp.clip_gains(t.judgments.withColumn("relevance", F.col("relevance") - 1))


@query("q11_alignment_counts", "products:i queries:i judgments:i judged_queries:i judged_products:i",
       with_("judgments_raw", "SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM supplier) AS queries, count(*) AS judgments, count(DISTINCT query_id) AS judged_queries, count(DISTINCT product_id) AS judged_products FROM judgments_raw"))
def _(t):
    return pp.alignment_counts(t.products, t.raw("supplier"), t.judgments_raw)


_ROW = "sha256('{{\"p_brand\":\"' || {b} || '\",\"p_name\":\"' || p_name || '\",\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}}')"


def _content(t):
    return t.raw("part").select("p_partkey", "p_name", "p_brand", "p_size")


@query("q12_content_digest", "p_partkey:i digest:s", f"SELECT p_partkey, {_ROW.format(b='p_brand')} AS digest FROM part")
def _(t):
    return pp.content_digest(_content(t), "p_partkey")


@query("q12_table_digest", "documents:i ids:i digest:s",
       f"SELECT count(*) AS documents, count(*) AS ids, CAST(sum(('0x' || substr({_ROW.format(b='p_brand')}, 1, 12))::HUGEINT) AS VARCHAR) AS digest FROM part")
def _(t):
    return pp.table_digest(_content(t), "p_partkey")


@query(
    "q12_compare_content", "expected:i live:i missing:i unexpected:i changed:i identical:b",
    "SELECT n AS expected, n - a + a2 AS live, a AS missing, a2 AS unexpected, c AS changed, false AS identical FROM (SELECT count(*) AS n, count(*) FILTER (p_size = 7) AS a, count(*) FILTER (p_size = 8) AS a2, count(*) FILTER (p_size = 9) AS c FROM part)",
)
def _(t):
    content = _content(t)
    live = content.where("p_size <> 7").withColumn("p_brand", F.when(F.col("p_size") == 9, "other").otherwise(F.col("p_brand")))
    return pp.compare_content(content, live.unionByName(content.where("p_size = 8").withColumn("p_partkey", -F.col("p_partkey") - 1)), "p_partkey")


# -- snapshots -----------------------------------------------------------------------------------

@query("s12_document_snapshot", "entity_id:i title:s generation_id:i model_revision:s embedding_eligible:b dims:i",
       "SELECT p_partkey AS entity_id, p_name AS title, 3 AS generation_id, 'r1' AS model_revision, vec_id IS NOT NULL AS embedding_eligible, coalesce(len(embedding), 0) AS dims FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def _(t):
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("entity_id"), "embedding")
    snapshot = dx.document_snapshot(t.products, vectors, 3, "r1")
    path = t.scratch("snapshot")
    snapshot.write.mode("overwrite").partitionBy("generation_id").parquet(path)
    stored = t.spark.read.schema(snapshot.schema).parquet(path)
    return stored.withColumn("dims", F.coalesce(F.size("embedding"), F.lit(0))).withColumn(
        "dims", F.when(F.col("embedding_eligible"), F.col("dims")).otherwise(0)
    )


@query("s13_join_vectors", "document_id:s first_a:f6 first_b:f6",
       with_("vec", "SELECT document_id, e[1] AS first_a, e[64] AS first_b FROM vec"))
def _(t):
    reversed_ = t.vectors.select("document_id", F.reverse("embedding").alias("embedding"))
    joined = dn.join_vectors(t.vectors.select("document_id"), {"a": t.vectors, "b": reversed_})
    return joined.select(
        "document_id", F.element_at("embedding_a", 1).alias("first_a"), F.element_at("embedding_b", 1).alias("first_b")
    )


@query("s13_vector_mismatch", "document_id:s fault:s",
       "SELECT CAST(coalesce(p_partkey, vec_id) AS VARCHAR) AS document_id, CASE WHEN p_partkey IS NULL THEN 'no_product' ELSE 'no_vector' END AS fault FROM part FULL JOIN embeddings ON vec_id = p_partkey WHERE p_partkey IS NULL OR vec_id IS NULL")
def _(t):
    return dn.missing_vectors(t.products, t.vectors)


_ENTRIES = (
    "entries AS (SELECT document_id, '[' || string_agg('{\"key\":\"' || term || '\",\"value\":' || tf || '.0}', ',' ORDER BY term) || ']' AS entries, count(*) AS n FROM dtf GROUP BY 1)"
)


@query("s14_verify_sparse", "corpus_records:i records:i missing:i extra:i embedding_values:i digest:s",
       with_more("dtf docs", _ENTRIES, "SELECT (SELECT count(*) FROM docs) AS corpus_records, count(*) AS records, (SELECT count(*) FROM docs) - count(*) AS missing, 0 AS extra, sum(n) AS embedding_values, "
                 "CAST(sum(('0x' || substr(sha256(document_id || chr(9) || entries), 1, 12))::HUGEINT) AS VARCHAR) AS digest FROM entries"))
def _(t):
    corpus = t.docs.select(F.col("document_id").alias("product_id"))
    return pp.sparse_corpus_check(t.sparse_vectors.withColumnRenamed("document_id", "product_id"), corpus)


@query("s14_sampled_rows", "position:i document_id:s entries:s",
       with_more("dtf", _ENTRIES, f"SELECT p AS position, document_id, entries FROM (SELECT *, row_number() OVER (ORDER BY {nat('document_id')}) - 1 AS p, count(*) OVER () AS total FROM entries) WHERE p IN (SELECT i * (total - 1) // 31 FROM range(32) r(i))"))
def _(t):
    from rankmill.functions.ids import natural_order

    return spanning_sample(t.sparse_vectors, natural_order("document_id"), 32).select("position", "document_id", pp.sparse_entries().alias("entries"))


@query("s14_order_faults", "product_id:i position:i expected_position:i",
       "SELECT p_partkey AS product_id, CASE WHEN (r - 1) % 10 = 3 THEN r ELSE r - 2 END AS position, r - 1 AS expected_position FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE (r - 1) % 10 IN (3, 4)")
def _(t):
    """Neighbours four and five of every ten have changed places."""
    from rankmill.operators.ordering import dense_index

    corpus = dense_index(t.raw("part").select(F.col("p_partkey").alias("product_id")), [F.col("product_id")])
    tenth = F.col("position") % 10
    return pp.order_faults(corpus.withColumn("position", F.col("position") + F.when(tenth == 3, 1).when(tenth == 4, -1).otherwise(0)), corpus)


@query("q12_differing_rows", "p_partkey:i fault:s",
       "SELECT p_partkey, CASE WHEN p_partkey % 211 = 5 THEN 'missing' ELSE 'changed' END AS fault FROM part WHERE p_partkey % 211 = 5 OR p_partkey % 307 = 9 UNION ALL SELECT -p_partkey - 1, 'unexpected' FROM part WHERE p_partkey % 401 = 7")
def _(t):
    """A live table against the expected one, top down over ranges of the key."""
    content, key = _content(t), F.col("p_partkey")
    live = content.where(key % 211 != 5).withColumn("p_brand", F.when(key % 307 == 9, "other").otherwise(F.col("p_brand")))
    return pp.differing_rows(content, live.unionByName(content.where(key % 401 == 7).withColumn("p_partkey", -key - 1)), "p_partkey", 64)
