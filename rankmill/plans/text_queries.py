"""Scalar text and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions import text as tx
from rankmill.functions import vectors as vx
from rankmill.functions.sparse import prune_sparse
from rankmill.operators import documents as dx
from rankmill.plans.oracle import tok, with_
from rankmill.plans.registry import query
from rankmill.session import spread

MODEL = {"dims": 64, "hf_id": "sample/encoder", "normalize": True, "revision": "r1"}


@query(
    "t01_canonicalize", "document_id:s text:s",
    "SELECT doc_id AS document_id, lower(regexp_replace(trim(nfc_normalize(text), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS text FROM documents",
)
def _(t):
    return t.docs.select("document_id", tx.canonicalize(F.col("text")).alias("text"))


_RENDERED = "trim(p_name) || '. ' || trim(p_name || ' by ' || p_brand) || '. ' || p_type || '. size ' || p_size"


def rendered(t):
    attributes = [F.col("product_class"), F.lit("  "), F.col("features")]
    return t.products.withColumn(
        "rendered", tx.render_document(F.col("title"), F.col("description"), attributes)
    )


@query("t02_render_document", "product_id:s rendered:s", f"SELECT p_partkey AS product_id, {_RENDERED} AS rendered FROM part")
def _(t):
    return rendered(t)


@query("t03_source_hash", "product_id:s source_hash:s", f"SELECT p_partkey AS product_id, sha256({_RENDERED}) AS source_hash FROM part")
def _(t):
    return rendered(t).select("product_id", tx.source_hash(F.col("rendered")).alias("source_hash"))


_INPUT = "'passage: ' || p_name || '. ' || p_name || ' by ' || p_brand || '. product class: ' || p_type || '. category: size ' || (p_size // 10) || '. features: size ' || p_size"


def embedding_inputs(t):
    attributes = tx.labelled_attributes(F.col("product_class"), F.col("category"), F.col("features"))
    return t.products.select(
        "product_id",
        tx.render_template(
            "{title}. {description}. {attributes}", "passage: ", title=F.col("title"),
            description=F.col("description"), attributes=attributes,
        ).alias("text"),
    )


@query("t04_embedding_input", "product_id:s text:s", f"SELECT p_partkey AS product_id, {_INPUT} AS text FROM part")
def _(t):
    return embedding_inputs(t)


@query("t05_render_query", "query_id:s text:s", "SELECT item_id AS query_id, 'query: ' || text AS text FROM benchmark")
def _(t):
    return t.queries.select(
        "query_id", tx.render_template("{query}", "query: ", query=F.col("query")).alias("text")
    )


@query(
    "t06_sparse_text", "product_id:s text:s",
    with_("products", "SELECT product_id, title || '. ' || brand || '. ' || category || '. ' || product_class || '. ' || features || '. ' || description AS text FROM products"),
)
def _(t):
    return t.products.select(
        "product_id",
        tx.sparse_text(*[F.col(c) for c in ("title", "brand", "category", "product_class", "features", "description")]).alias("text"),
    )


@query(
    "t07_cache_key", "product_id:s cache_key:s",
    f"""SELECT p_partkey AS product_id, sha256('{{"document_text":"' || {_INPUT} || '","model":{{"dims":64,"hf_id":"sample/encoder","normalize":true,"revision":"r1"}}}}') AS cache_key FROM part""",
)
def _(t):
    return embedding_inputs(t).select("product_id", tx.cache_key(F.col("text"), MODEL).alias("cache_key"))


# The named references that the pages hold, "&amp;" first, as the decoded text is not decoded again.
_PLAIN = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace({0}, '&amp;', chr(1)), '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '\"'), chr(1), '&'), "
    "'<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
)


@query("t08_plain_text", "page_id:i words:i characters:i text:s",
       f"SELECT page_id, len({tok('text')}) AS words, length(text) AS characters, text FROM (SELECT page_id, {_PLAIN.format('html')} AS text FROM pages)")
def _(t):
    pages = t.raw("pages").select("page_id", tx.plain_text(F.col("html")).alias("text"))
    return pages.select(
        "page_id", F.size(tx.tokenize(F.col("text"))).alias("words"), F.length("text").alias("characters"), "text"
    )


@query(
    "t09_category_text", "product_id:i category:s",
    with_("category_products", "SELECT product_id, string_agg(path, ' | ' ORDER BY k) AS category FROM (SELECT DISTINCT product_id, r_name || ' / ' || n_name AS path, "
          "lower(r_name) || ' / nation_' || lpad(CAST(n_nationkey AS VARCHAR), 20, '0') AS k FROM category_products JOIN nation ON category_id = n_nationkey + 100 JOIN region ON n_regionkey = r_regionkey) GROUP BY 1"),
)
def _(t):
    return dx.category_text(t.category_products, t.categories)


@query(
    "t10_brand_and_features", "product_id:s brand:s features:s",
    with_("products", "SELECT product_id, CASE WHEN p_size % 7 = 0 THEN product_class ELSE brand END AS brand, "
          "CASE WHEN product_class = 'SMALL' THEN features || ' | SMALL' WHEN p_size % 2 = 0 THEN features || ' | ' || product_class ELSE features END AS features FROM products"),
)
def _(t):
    brand, features = dx.brand_and_features(
        [F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.col("brand")), F.col("product_class")],
        [
            F.col("features"), F.lit(None).cast("string"), F.col("features"),
            F.when((F.col("p_size") % 2 == 0) | (F.col("product_class") == "SMALL"), F.col("product_class")).otherwise(F.lit("")),
        ],
    )
    return t.products.select("product_id", brand.alias("brand"), features.alias("features"))


@query(
    "t11_group_prices", "product_id:i position:i customer_group_id:i website_id:i regular_price:f6 final_price:f6 tier_price:f6",
    "SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY customer_group_id, website_id) - 1 AS position FROM ("
    "SELECT l_partkey AS product_id, l_linenumber AS customer_group_id, n_regionkey AS website_id, max(l_extendedprice) AS regular_price, "
    "min(l_extendedprice) AS final_price, CASE WHEN max(l_discount) > 0.05 THEN max(l_discount) ELSE -1 END AS tier_price "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)",
)
def _(t):
    prices = (
        t.raw("lineitem").join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("customer_group_id"),
            F.col("n_regionkey").alias("website_id"),
        ).agg(
            F.lit(1).alias("tax_class_id"), F.max("l_extendedprice").alias("regular_price"),
            F.min("l_extendedprice").alias("final_price"), F.min("l_extendedprice").alias("min_price"),
            F.max("l_extendedprice").alias("max_price"),
            F.when(F.max("l_discount") > 0.05, F.max("l_discount")).alias("tier_price"),
        )
    )
    return dx.group_prices(prices).select(
        "product_id", F.posexplode("customer_group_prices").alias("position", "p")
    ).select("product_id", "position", "p.*").withColumn("tier_price", F.coalesce("tier_price", F.lit(-1.0)))


@query("t12_tokenize", "document_id:s tokens:s", f"SELECT doc_id AS document_id, array_to_string({tok('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.docs.select("document_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query("t13_stemmed_positions", "document_id:s position:i term:s",
       f"SELECT document_id, unnest(range(len(w))) AS position, unnest(w) AS term FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, {tok(_PLAIN.format('text'))} AS w FROM documents)")
def _(t):
    """Every word stays at its place; its stem, if another, is stacked on the same position."""
    words = t.docs.select("document_id", tx.tokenize(tx.plain_text(F.col("text"))).alias("words"))
    found = words.select("document_id", "words", tx.stacked_stems(F.col("words")).alias("o"))
    kept = F.filter("o", lambda o: o["term"] == F.get("words", o["position"]))
    return found.select("document_id", F.inline(kept))


@query("t13_tokenize_stemmed", "document_id:s positions:i terms:i")
def _(t):
    found = t.docs.select("document_id", tx.stemmed_occurrences(F.col("text")).alias("o"))
    return found.select(
        "document_id", F.size(F.array_distinct("o.position")).alias("positions"), F.size("o").alias("terms")
    )


@query(
    "t14_token_count", "conv_id:i turn:i token_count:i",
    "SELECT conv_id, turn, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')) AS token_count FROM conversations",
)
def _(t):
    return t.raw("conversations").select("conv_id", "turn", tx.token_count(F.col("text")).alias("token_count"))


@query(
    "t15_hash_embedding", "document_id:s bucket:i value:f6",
    with_("dvec", "SELECT d.document_id, b.bucket, coalesce(v.v, 0) AS value FROM (SELECT DISTINCT document_id FROM dvec) d CROSS JOIN (SELECT unnest(range(32)) AS bucket) b "
          "LEFT JOIN dvec v ON v.document_id = d.document_id AND v.bucket = b.bucket"),
)
def _(t):
    return t.doc_vectors.select("document_id", F.posexplode("embedding").alias("bucket", "value"))


@query(
    "t16_deterministic_embedding", "product_id:s first:f6 last:f6 weighted:f6",
    "SELECT product_id, e[1] / m AS first, e[256] / m AS last, list_sum(list_transform(e, lambda x, i: x * i)) / m AS weighted FROM ("
    "SELECT *, sqrt(list_dot_product(e, e)) AS m FROM (SELECT p_partkey AS product_id, "
    f"list_transform(range(256), lambda i: CAST(('0x' || substr(sha256({_RENDERED} || ':' || i), 1, 4))::BIGINT AS DOUBLE) / 65535 * 2 - 1) AS e FROM part))",
)
def _(t):
    texts = spread(rendered(t).select("product_id", "rendered"))  # a small file would be one task
    made = texts.select("product_id", vx.deterministic_embedding(F.col("rendered")).alias("e"))
    weighted = F.aggregate(F.transform("e", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "product_id", F.element_at("e", 1).alias("first"), F.element_at("e", -1).alias("last"), weighted.alias("weighted")
    )


@query(
    "t17_truncate_then_normalize", "document_id:s first:f6 last:f6 norm:f6",
    with_("vec", "SELECT document_id, e[1] / m AS first, e[32] / m AS last, 1.0 AS norm FROM (SELECT document_id, e, sqrt(list_dot_product(e[1:32], e[1:32])) AS m FROM vec)"),
)
def _(t):
    short = t.vectors.select("document_id", vx.truncate_then_normalize(F.col("embedding"), 32).alias("v"))
    return short.select(
        "document_id", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"), vx.norm(F.col("v")).alias("norm")
    )


def scaled_vectors(t):
    """Real vectors with some stretched, so that the checks have something to find."""
    factor = F.when(F.col("label") == 3, 1.01).otherwise(1.0)
    return t.vectors.select(
        "document_id",
        F.when(F.col("label") == 7, F.slice("embedding", 1, 63).cast("array<double>"))
        .otherwise(F.transform("embedding", lambda x: x.cast("double") * factor)).alias("embedding"),
    )


@query(
    "t18_validate_vectors", "document_id:s fault:s",
    with_("vec", "SELECT document_id, CASE WHEN label = 7 THEN 'dimension' ELSE 'not_unit_length' END AS fault FROM vec WHERE label IN (3, 7)"),
)
def _(t):
    checked = scaled_vectors(t).withColumn("fault", vx.vector_fault(F.col("embedding"), 64, 1e-3))
    return checked.where(F.col("fault").isNotNull())


# Single-precision bits of a value, low byte first.
_BITS = (
    "array_to_string(list_transform(list_transform(list_transform(embedding, lambda x: {'x': CAST(x AS DOUBLE), 'e': CASE WHEN x = 0 THEN 0 ELSE CAST(floor(log2(abs(CAST(x AS DOUBLE)))) AS BIGINT) END}), "
    "lambda s: printf('%08x', CASE WHEN s.x = 0 THEN 0 ELSE CASE WHEN s.x < 0 THEN 2147483648 ELSE 0 END + (s.e + 127) * 8388608 + CAST((abs(s.x) / pow(2, s.e) - 1) * 8388608 AS BIGINT) END)), "
    "lambda h: substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)), '')"
)


@query("t19_base64_round_trip", "document_id:s characters:i payload:s same:b vector_hash:s",
       f"SELECT vec_id AS document_id, length(to_base64(b)) AS characters, to_base64(b) AS payload, true AS same, sha256(b) AS vector_hash FROM (SELECT vec_id, unhex({_BITS}) AS b FROM embeddings)")
def _(t):
    coded = t.vectors.select("document_id", "embedding", vx.to_base64(F.col("embedding")).alias("b"))
    return coded.select(
        "document_id", F.length("b").alias("characters"), F.col("b").alias("payload"),
        (vx.from_base64(F.col("b")) == F.col("embedding")).alias("same"),
        vx.vector_hash(F.col("embedding")).alias("vector_hash"),
    )


@query(
    "t20_prune_sparse", "document_id:s token:s weight:f6",
    with_("dtf", "SELECT document_id, term AS token, tf AS weight FROM dtf QUALIFY tf >= 0.4 * max(tf) OVER (PARTITION BY document_id)"),
)
def _(t):
    return t.sparse_vectors.select(
        "document_id", F.explode(prune_sparse(F.col("embedding"), 0.4)).alias("token", "weight")
    )


@query("t19_base64_characters", "document_id:s characters:i same:b",
       "SELECT vec_id AS document_id, 4 * ((len(embedding) * 4 + 2) // 3) AS characters, true AS same FROM embeddings")
def _(t):
    coded = t.vectors.select("document_id", "embedding", vx.to_base64(F.col("embedding")).alias("b"))
    return coded.select("document_id", F.length("b").alias("characters"), (vx.from_base64(F.col("b")) == F.col("embedding")).alias("same"))


@query(
    "t21_canonical_float32", "document_id:s digest:s",
    "SELECT vec_id AS document_id, sha256(array_to_string(list_transform(list_transform(embedding, lambda x: {'x': CAST(x AS DOUBLE), 'e': CASE WHEN x = 0 THEN 0 ELSE CAST(floor(log2(abs(CAST(x AS DOUBLE)))) AS BIGINT) END}), "
    "lambda s: printf('%08x', CASE WHEN s.x = 0 THEN 0 ELSE CASE WHEN s.x < 0 THEN 2147483648 ELSE 0 END + (s.e + 127) * 8388608 + CAST((abs(s.x) / pow(2, s.e) - 1) * 8388608 AS BIGINT) END)), '')) AS digest FROM embeddings",
)
def _(t):
    return t.vectors.select(
        "document_id", F.sha2(F.array_join(vx.canonical_float32(F.col("embedding")), ""), 256).alias("digest")
    )
