"""Readers and writers: tables are written in each file format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions.text import cache_key
from rankmill.sources import files as fs
from rankmill.sources import telemetry_log as tl
from rankmill.plans.oracle import tok, with_
from rankmill.plans.registry import query


def _write_tsv(df, path):
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return path


def catalog_path(t):
    """Products as TSV: some ids blank, some titles blank, some ratings not numeric, some rows twice."""
    raw = t.raw("part").select(
        F.when(F.col("p_size") == 11, " ").otherwise(F.col("p_partkey").cast("string")).alias("product_id"),
        F.when(F.col("p_size") == 12, "").otherwise(F.col("p_name")).alias("product_name"),
        F.col("p_type").alias("product_class"), F.concat(F.lit("home / "), "p_type").alias("category hierarchy"),
        F.concat_ws(" ", "p_name", "p_brand").alias("product_description"), F.concat(F.lit("size : "), "p_size").alias("product_features"),
        F.when(F.col("p_size") == 13, "many").when(F.col("p_size") == 14, "NaN").otherwise(F.col("p_size").cast("string")).alias("rating_count"),
        F.col("p_retailprice").cast("string").alias("average_rating"), F.lit("").alias("review_count"),
    )
    again = raw.join(t.raw("part").where("p_size = 15").select(F.col("p_partkey").cast("string").alias("product_id")), "product_id", "left_semi")
    return _write_tsv(raw.unionByName(again), t.scratch("products-tsv"))


@query("s01_read_catalog_tsv", "product_id:s title:s description:s category:s product_class:s features:s rating_count:f6 average_rating:f6 has_reviews:b",
       "SELECT p_partkey AS product_id, p_name AS title, p_name || ' ' || p_brand AS description, 'home / ' || p_type AS category, p_type AS product_class, 'size : ' || p_size AS features, p_size AS rating_count, p_retailprice AS average_rating, false AS has_reviews FROM part WHERE p_size NOT IN (11, 12, 13, 14, 15)")
def _(t):
    return fs.read_catalog_tsv(t.spark, catalog_path(t)).withColumn("has_reviews", F.col("review_count").isNotNull())


@query("s01_catalog_rejects", "fault:s rows:i",
       "SELECT CASE p_size WHEN 11 THEN 'product_id' WHEN 12 THEN 'product_name' WHEN 15 THEN 'duplicate' ELSE 'number' END AS fault, count(*) * any_value(CASE p_size WHEN 15 THEN 2 ELSE 1 END) AS rows FROM part WHERE p_size IN (11, 12, 13, 14, 15) GROUP BY 1")
def _(t):
    return fs.catalog_rejects(t.spark, catalog_path(t)).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


@query("s02_read_query_tsv", "query_id:s query:s query_class:s token_count:i",
       "SELECT conv_id || '-' || turn AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query, role AS query_class, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')) AS token_count FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def _(t):
    rows = t.raw("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query"), F.col("role").alias("query_class")
    )
    return fs.read_query_tsv(t.spark, _write_tsv(rows, t.scratch("queries-tsv")))


@query("s02_read_label_tsv", "id:s query_id:s product_id:s label:s",
       with_("judgments_raw", "SELECT l_orderkey || '-' || l_linenumber || '-' || product_id AS id, query_id, product_id, label FROM judgments_raw"))
def _(t):
    rows = t.judgments_raw.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "product_id").alias("id"), "query_id", "product_id", "label")
    return fs.read_label_tsv(t.spark, _write_tsv(rows, t.scratch("labels-tsv")))


@query("s02_query_rejects", "query_id:s query_class:s", "SELECT conv_id || '-' || turn AS query_id, role AS query_class FROM conversations WHERE turn % 3 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''")
def _(t):
    rows = t.raw("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.when(F.col("turn") % 3 != 0, F.trim(F.regexp_replace("text", r"\s+", " "))).otherwise(" ").alias("query"), F.col("role").alias("query_class"),
    )
    return fs.query_rejects(t.spark, _write_tsv(rows, t.scratch("queries-tsv")))


@query("s02_label_rejects", "id:s query_id:s", with_("judgments_raw", "SELECT l_orderkey || '-' || l_linenumber || '-' || product_id AS id, query_id FROM judgments_raw WHERE label = 'Partial'"))
def _(t):
    label = F.when(F.col("label") != "Partial", F.col("label"))
    rows = t.judgments_raw.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "product_id").alias("id"), "query_id", "product_id", label.alias("label"))
    return fs.label_rejects(t.spark, _write_tsv(rows, t.scratch("labels-tsv")))


_FLAT = "regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g')"


def flat_docs(t):
    return t.docs.select("document_id", "brand", F.regexp_replace("text", r"[\t\n\r]+", " ").alias("text"))


@query("s03_read_trec_collection", "product_id:s title:s description:s", f"SELECT doc_id AS product_id, source AS title, {_FLAT} AS description FROM documents WHERE source <> 'src3'")
def _(t):
    path = t.scratch("collection")
    line = F.when(F.col("brand") == "src3", F.col("text")).otherwise(F.concat_ws("\t", "document_id", "brand", "text"))
    flat_docs(t).select(line.alias("value")).write.option("compression", "gzip").text(path)
    return fs.read_trec_collection(t.spark, path)


@query("s03_read_trec_json", "product_id:s title:s description:s", "SELECT doc_id AS product_id, source AS title, text AS description FROM documents WHERE source <> 'src3'")
def _(t):
    path = t.scratch("collection-json")
    t.docs.select(
        F.col("document_id").alias("docid"), F.when(F.col("brand") != "src3", F.col("brand")).alias("title"), "text"
    ).write.json(path)
    return fs.read_trec_json(t.spark, path)


@query("s03_trec_json_rejects", "docid:s description:s", "SELECT doc_id AS docid, text AS description FROM documents WHERE source = 'src3'")
def _(t):
    path = t.scratch("collection-json")
    t.docs.select(
        F.col("document_id").alias("docid"), F.when(F.col("brand") != "src3", F.col("brand")).alias("title"), "text"
    ).write.json(path)
    return fs.trec_json_rejects(t.spark, path).withColumnRenamed("text", "description")


@query("s04_read_trec_topics", "query_id:s query:s", "SELECT item_id AS query_id, regexp_replace(text, '\\s+', ' ', 'g') AS query FROM benchmark")
def _(t):
    rows = t.queries.select(F.col("query_id").alias("id"), F.regexp_replace("query", r"\s+", " ").alias("query"))
    blank = rows.limit(1).select("id", F.lit(" ").alias("query"))
    return fs.read_trec_topics(t.spark, _write_tsv(rows.unionByName(blank), t.scratch("topics")))


@query("s05_qrels_round_trip", "query_id:s document_id:s relevance:i", with_("judgments", "SELECT * FROM judgments"))
def _(t):
    path = t.scratch("qrels")
    fs.write_qrels(t.judgments, path)
    return fs.read_qrels(t.spark, path)


@query("s05_line_rejects", "line:s", "SELECT 'bad line ' || s_suppkey AS line FROM supplier UNION ALL SELECT s_suppkey || ' 0 d high' FROM supplier")
def _(t):
    path = t.scratch("qrels")
    good = t.judgments.select(F.format_string("%s 0 %s %d", "query_id", "document_id", "relevance").alias("value"))
    bad = t.raw("supplier").select(F.explode(F.array(
        F.concat(F.lit("bad  line "), "s_suppkey"), F.concat(F.col("s_suppkey").cast("string"), F.lit(" 0 d high"))
    )).alias("value"))
    good.unionByName(bad).write.text(path)
    return fs.qrels_rejects(t.spark, path)


@query("s06_line_rejects", "line:s", "SELECT unnest(['q Q0 d' || s_suppkey || ' first 1.5 t', 'q Q0 d' || s_suppkey || ' 1 much t', 'q Q1 d' || s_suppkey || ' 1 1.5 t']) AS line FROM supplier")
def _(t):
    path = t.scratch("run")
    name = F.concat(F.lit("q Q0 d"), F.col("s_suppkey").cast("string"))
    bad = t.raw("supplier").select(F.explode(F.array(
        F.concat(name, F.lit(" first 1.5 t")), F.concat(name, F.lit(" 1 much t")), F.concat(F.lit("q Q1 d"), F.col("s_suppkey").cast("string"), F.lit(" 1 1.5 t")),
        F.concat(name, F.lit(" 1 1.5 t")),
    )).alias("value"))
    bad.write.text(path)
    return fs.run_rejects(t.spark, path)


@query("s06_run_round_trip", "query_id:s document_id:s rank:i score:f9 tag:s",
       with_("runs", "SELECT query_id, document_id, rank, CAST(printf('%.12g', score / 7) AS DOUBLE) AS score, 'price' AS tag FROM runs WHERE system = 'price'"))
def _(t):
    path = t.scratch("run")
    fs.write_run(t.run("price").withColumn("score", F.col("score") / 7), path)
    return fs.read_run(t.spark, path)


@query("s07_products_jsonl", "product_id:s title:s brand:s features:s average_rating:f6", with_("products", "SELECT product_id, title, brand, features, price AS average_rating FROM products"))
def _(t):
    path = t.scratch("products-jsonl")
    rows = t.products.select(
        "product_id", "title", "description", "category", "product_class", "brand", "features",
        F.lit(None).cast("double").alias("rating_count"), F.col("price").alias("average_rating"), F.lit(None).cast("double").alias("review_count"),
    )
    fs.write_jsonl(rows, path)
    return fs.read_products_jsonl(t.spark, path)


@query("s07_queries_jsonl", "query_id:s query:s split:s token_count:i",
       f"SELECT item_id AS query_id, text AS query, 'test' AS split, len({tok('text')}) AS token_count FROM benchmark WHERE sha256('x' || item_id) >= '8'")
def _(t):
    from rankmill.functions.text import tokenize

    path = t.scratch("queries-jsonl")
    rows = t.queries.select(
        "query_id", "query", F.lit("").alias("query_class"),
        F.when(F.sha2(F.concat(F.lit("x"), "query_id"), 256) >= "8", "test").otherwise("dev").alias("split"),
        F.size(tokenize(F.col("query"))).alias("token_count"),
    )
    fs.write_jsonl(rows, path)
    return fs.read_queries_jsonl(t.spark, path, "test")


def sparse_path(t):
    path = t.scratch("sparse-jsonl")
    broken = F.conv(F.substring(F.sha2("document_id", 256), 1, 4), 16, 10).cast("int") % 20
    body = (
        F.when(broken == 0, F.lit("{}"))
        .when(broken == 1, F.lit('{"a":"heavy"}'))
        .otherwise(F.to_json("embedding"))
    )
    identity = F.when(broken == 2, "").otherwise(F.col("document_id"))
    t.sparse_vectors.select(
        F.concat(F.lit('{"product_id":"'), identity, F.lit('","embedding":'), body, F.lit("}")).alias("value")
    ).write.text(path)
    return path


_BROKEN = "('0x' || substr(sha256(document_id), 1, 4))::INTEGER % 20"


@query("s08_read_sparse_vectors", "product_id:s token:s weight:f6",
       with_("dtf", f"SELECT document_id AS product_id, term AS token, tf AS weight FROM dtf WHERE {_BROKEN} > 2"))
def _(t):
    return fs.read_sparse_vectors(t.spark, sparse_path(t)).select("product_id", F.explode("embedding").alias("token", "weight"))


@query("s08_sparse_rejects", "fault:s rows:i",
       with_("dlen", f"SELECT CASE {_BROKEN} WHEN 0 THEN 'empty' WHEN 1 THEN 'weight' ELSE 'product_id' END AS fault, count(*) AS rows FROM dlen WHERE {_BROKEN} <= 2 GROUP BY 1"))
def _(t):
    return fs.sparse_rejects(t.spark, sparse_path(t)).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


@query("s09_vector_table", "document_id:s dims:i intact:b", "SELECT vec_id AS document_id, len(embedding) AS dims, true AS intact FROM embeddings")
def _(t):
    path = t.scratch("vectors")
    generator = {"model": "sample/encoder", "revision": "r1"}
    keyed = t.vectors.select("document_id", cache_key(F.col("document_id"), {"revision": "r1"}).alias("cache_key"), "embedding")
    fingerprint = fs.write_vector_table(keyed, path, generator)
    fs.write_vector_table(keyed, path, dict(generator, revision="r2"))
    return fs.read_vector_table(t.spark, path, fingerprint)


def log_lines(t, events=None):
    """Events as telemetry log lines; cheap ones are broken in several ways, others unmarked."""
    e = (t.telemetry if events is None else events).select("*", (F.col("duration_ms") * 100).cast("int").alias("v"))
    record = F.to_json(
        F.struct(
            F.when(F.col("v") % 50 == 1, 2).otherwise(1).alias("schema_version"), F.lit("query_route").alias("event"),
            F.when(F.col("v") % 50 == 2, 0).otherwise(F.col("store_id")).alias("store_id"), "request_name",
            F.when(F.col("v") % 50 == 3, "detour").otherwise(F.col("route")).alias("route"), "reason",
            F.when(F.col("v") % 50 == 4, 70000.0).otherwise(F.col("duration_ms")).alias("duration_ms"), "components",
        )
    )
    text = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00] main.INFO: "),
        F.when(F.col("v") % 50 == 5, "other message.").otherwise("query telemetry."), F.lit(" "), record, F.lit(" []"),
    )
    return e.select(text.alias("value"))


_CAST_V = "CAST(trunc(duration_ms * 100) AS INTEGER) % 50"


@query("s10_read_telemetry_log", "store_id:i request_name:s route:s reason:s requests:i total_ms:f4 first_us:i last_us:i",
       with_("telemetry", f"SELECT store_id, request_name, route, reason, count(*) AS requests, sum(duration_ms) AS total_ms, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM telemetry WHERE {_CAST_V} NOT IN (1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4"))
def _(t):
    path = t.scratch("log")
    log_lines(t).write.text(path)
    return tl.telemetry_records(t.spark.read.text(path)).groupBy("store_id", "request_name", "route", "reason").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("duration_ms").alias("total_ms"),
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"),
    )


@query("s10_telemetry_components", "component:s outcome:s observations:i total_ms:f4",
       with_("components", f"SELECT component, outcome, count(*) AS observations, sum(ms) AS total_ms FROM components WHERE {_CAST_V} NOT IN (1, 2, 3, 4, 5) GROUP BY 1, 2"))
def _(t):
    path = t.scratch("log")
    log_lines(t).write.text(path)
    parts = tl.telemetry_records(t.spark.read.text(path)).select(F.explode("components").alias("component", "m"))
    return parts.groupBy("component", F.col("m.outcome").alias("outcome")).agg(
        F.count(F.lit(1)).alias("observations"), F.sum("m.duration_ms").alias("total_ms")
    )


@query("q13_file_facts", "records:i some_bytes:b", with_("judgments", "SELECT count(*) AS records, true AS some_bytes FROM judgments"))
def _(t):
    path = t.scratch("qrels")
    fs.write_qrels(t.judgments, path)
    return fs.file_facts(t.spark, path).withColumn("some_bytes", F.col("bytes") > 0)
