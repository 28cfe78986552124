"""Common table expressions for the SQL side, mirroring `tables.py`."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_(names: str, body: str) -> str:
    """`body` preceded by the named expressions and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTES[name][0]:
                visit(need)
            order.append(name)

    for name in names.split():
        visit(name)
    listed = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {listed} {body}"


def nat(column: str) -> str:
    """Natural id order."""
    return (
        f"CASE WHEN regexp_full_match({column}, '[0-9]+') THEN 0 ELSE 1 END, "
        f"TRY_CAST({column} AS HUGEINT), {column}"
    )


def tok(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+')"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"


def ranked(source: str, keys: str, order: str, k: int, rank: str = "rank") -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {rank} "
        f"FROM {source} QUALIFY {rank} <= {k}"
    )


BEST = f"score DESC, {nat('document_id')}"

# -- text --
cte("docs", "SELECT CAST(doc_id AS VARCHAR) AS document_id, text, lang AS product_class, source AS brand FROM documents")
cte("queries", "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark")
cte("passage_qrels", "SELECT query_id, document_id, 2 AS relevance FROM docs JOIN queries ON contains(text, query)", "docs", "queries")
cte("dtok", f"SELECT document_id, {tok('text')} AS toks FROM docs", "docs")
cte("dlen", "SELECT document_id, len(toks) AS dl FROM dtok WHERE len(toks) > 0", "dtok")
cte("dstat", "SELECT count(*) AS n, avg(dl) AS avgdl FROM dlen", "dlen")
cte("dtf", "SELECT document_id, term, count(*) AS tf FROM (SELECT document_id, unnest(toks) AS term FROM dtok) GROUP BY ALL", "dtok")
cte("ddf", "SELECT term, count(*) AS df FROM dtf GROUP BY ALL", "dtf")
cte("qterm", f"SELECT query_id, term, count(*) AS w FROM (SELECT query_id, unnest({tok('query')}) AS term FROM queries) GROUP BY ALL", "queries")
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
SAT = "tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"
cte("bm25", f"SELECT query_id, document_id, sum(w * {IDF} * {SAT}) AS score, count(*) AS matched "
    "FROM qterm JOIN dtf USING (term) JOIN ddf USING (term) JOIN dlen USING (document_id), dstat GROUP BY 1, 2",
    "qterm", "dtf", "ddf", "dlen", "dstat")
cte("lexrun", ranked("(SELECT query_id, document_id, round(score, 6) AS score FROM bm25)", "query_id", BEST, 100), "bm25")

# -- products --
cte("products", "SELECT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_partkey AS VARCHAR) AS document_id, "
    "p_partkey AS entity_id, p_name AS title, p_name || ' by ' || p_brand AS description, "
    "'size ' || (p_size // 10) AS category, p_type AS product_class, p_brand AS brand, "
    "'size ' || p_size AS features, 'RW-' || p_partkey AS sku, "
    "CASE WHEN p_size % 10 = 0 THEN 2 ELSE 1 END AS status, p_size % 4 + 1 AS visibility, "
    "p_partkey % 3 <> 0 AS is_salable, p_retailprice AS price, p_size FROM part")
cte("pqueries", "SELECT DISTINCT replace(lower(p_type || ' ' || p_name), ' ', '-') AS query_id, p_type || ' ' || p_name AS query FROM part")
FIELDS = ("title", "product_class", "category", "brand", "description", "features")
cte("ptok", " UNION ALL ".join(
    f"SELECT '{f}' AS field, product_id AS document_id, {tok(f)} AS toks FROM products" for f in FIELDS), "products")
cte("plen", "SELECT field, document_id, len(toks) AS dl FROM ptok WHERE len(toks) > 0", "ptok")
cte("pstat", "SELECT field, count(*) AS n, avg(dl) AS avgdl FROM plen GROUP BY 1", "plen")
cte("ptf", "SELECT field, document_id, term, count(*) AS tf FROM (SELECT field, document_id, unnest(toks) AS term FROM ptok) GROUP BY ALL", "ptok")
cte("pdf", "SELECT field, term, count(*) AS df FROM ptf GROUP BY ALL", "ptf")
cte("pqterm", f"SELECT query_id, term, count(*) AS w, any_value(nt) AS nt FROM (SELECT query_id, len(list_distinct({tok('query')})) AS nt, unnest({tok('query')}) AS term FROM pqueries) GROUP BY query_id, term", "pqueries")
cte("pfield", f"SELECT query_id, field, document_id, any_value(nt) AS nt, sum(w * {IDF} * {SAT}) AS score, count(*) AS matched "
    "FROM pqterm JOIN ptf USING (term) JOIN pdf USING (field, term) JOIN plen USING (field, document_id) JOIN pstat USING (field) "
    "GROUP BY query_id, field, document_id", "pqterm", "ptf", "pdf", "plen", "pstat")

# -- judgments and runs --
cte("judgments_raw", "SELECT CAST(l_suppkey AS VARCHAR) AS query_id, CAST(l_partkey AS VARCHAR) AS product_id, "
    "CASE l_returnflag WHEN 'A' THEN 'Exact' WHEN 'N' THEN 'Partial' ELSE 'Irrelevant' END AS label, "
    "CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS gain, l_linestatus, l_orderkey, l_linenumber FROM lineitem")
cte("judgments", "SELECT query_id, product_id AS document_id, gain AS relevance FROM "
    "(SELECT query_id, product_id, gain, count(*) AS votes FROM judgments_raw GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY votes DESC, gain) = 1", "judgments_raw")
cte("qrels", "SELECT * FROM judgments WHERE ('0x' || substr(md5(query_id || '|' || document_id), 1, 7))::BIGINT % 2 = 0", "judgments")
cte("pair_values", "SELECT CAST(l_suppkey AS VARCHAR) AS query_id, CAST(l_partkey AS VARCHAR) AS document_id, "
    "max(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY 1, 2")
cte("runs", ranked("(" + " UNION ALL ".join(
    f"SELECT '{s}' AS system, query_id, document_id, {s} AS score FROM pair_values" for s in ("quantity", "price", "discount")) + ")",
    "system, query_id", BEST, 100), "pair_values")
cte("pair_scores", "SELECT query_id, document_id, ('0x' || substr(sha256(query_id || '|' || document_id), 1, 7))::BIGINT / 268435456.0 AS score FROM pair_values", "pair_values")
# per-query metrics of every system
cte("ideal", "SELECT query_id, sum(CASE WHEN place <= 10 THEN relevance / log2(place + 1) END) AS i10, sum(relevance / log2(place + 1)) AS i50, "
    "any_value(relevant) AS relevant FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS place, "
    "count(*) FILTER (relevance > 0) OVER (PARTITION BY query_id) AS relevant FROM qrels QUALIFY place <= 50) GROUP BY 1", "qrels")
METRIC_SQL = (
    "coalesce(sum(coalesce(q.relevance, 0) / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10, "
    "coalesce(sum(coalesce(q.relevance, 0) / log2(rank + 1)) FILTER (rank <= 50), 0) AS d50, "
    "count(*) FILTER (rank <= 100 AND q.relevance > 0) AS found, "
    "min(rank) FILTER (rank <= 10 AND q.relevance = 2) AS first, "
    "count(*) FILTER (rank <= 10 AND q.relevance IS NOT NULL) AS judged"
)
cte("measured", f"SELECT system, r.query_id, {METRIC_SQL} FROM runs r LEFT JOIN qrels q USING (query_id, document_id) GROUP BY 1, 2", "runs", "qrels")
cte("systems", "SELECT DISTINCT system FROM runs", "runs")
cte("metrics", "SELECT s.system, i.query_id, CASE WHEN i10 > 0 THEN coalesce(d10, 0) / i10 ELSE 0 END AS ndcg10, "
    "CASE WHEN i50 > 0 THEN coalesce(d50, 0) / i50 ELSE 0 END AS ndcg50, "
    "CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant ELSE 0 END AS recall100, "
    "coalesce(1.0 / first, 0) AS mrr10, coalesce(judged, 0) / 10.0 AS judged10 "
    "FROM ideal i CROSS JOIN systems s LEFT JOIN measured m ON m.query_id = i.query_id AND m.system = s.system",
    "ideal", "systems", "measured")

# -- vectors --
cte("vec", "SELECT CAST(vec_id AS VARCHAR) AS document_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings")
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
cte("sims", f"SELECT a.document_id AS query_id, b.document_id AS document_id, round((1 + {COS.format(a='a.e', b='b.e')}) / 2, 6) AS score FROM vec a, vec b", "vec")
FEATURES = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))"


def hash_vectors(name: str, source: str, key: str, text: str) -> None:
    cte(f"{name}_b", f"SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 32 AS bucket, "
        "sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v "
        f"FROM (SELECT {key}, sha256(unnest({FEATURES})) AS h FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {source})) GROUP BY ALL", source)
    cte(name, f"SELECT {key}, bucket, CAST(v AS DOUBLE) / sqrt(sum(CAST(v AS DOUBLE) * v) OVER (PARTITION BY {key})) AS v FROM {name}_b "
        f"QUALIFY sum(v * v) OVER (PARTITION BY {key}) > 0", f"{name}_b")


hash_vectors("dvec", "docs", "document_id", "text")
hash_vectors("qvec", "queries", "query_id", "query")
cte("dense_all", "SELECT q.query_id, d.document_id, round((1 + coalesce(s, 0)) / 2, 6) AS score "
    "FROM (SELECT DISTINCT query_id FROM qvec) q CROSS JOIN (SELECT DISTINCT document_id FROM dvec) d "
    "LEFT JOIN (SELECT query_id, document_id, sum(q.v * d.v) AS s FROM qvec q JOIN dvec d USING (bucket) GROUP BY 1, 2) x "
    "ON x.query_id = q.query_id AND x.document_id = d.document_id", "qvec", "dvec")
cte("denserun", ranked("dense_all", "query_id", BEST, 100), "dense_all")
cte("qtokens", f"SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM queries", "queries")
cte("sparse_all", "SELECT query_id, document_id, CAST(sum(tf) AS DOUBLE) AS score FROM qtokens JOIN dtf USING (term) GROUP BY 1, 2", "qtokens", "dtf")
cte("sparserun", ranked("sparse_all", "query_id", BEST, 100), "sparse_all")


def norm_clause(run: str) -> str:
    return (
        f"SELECT query_id, document_id, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0 "
        f"ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS v "
        f"FROM {run} WINDOW p AS (PARTITION BY query_id)"
    )


def fused(runs: list[str], weights: list[float], k: int = 100) -> str:
    parts = " UNION ALL ".join(
        f"SELECT query_id, document_id, {w} * v AS wv FROM ({norm_clause(r)})" for r, w in zip(runs, weights)
    )
    return ranked(f"(SELECT query_id, document_id, round(sum(wv), 6) AS score FROM ({parts}) GROUP BY 1, 2)", "query_id", BEST, k)


# -- events --
cte("ev", "SELECT event_id, epoch_us(ts) AS us, ts, user_id, event_type, value, props FROM events")
cte("journal", "SELECT event_id + 1 AS change_id, user_id % 3 + 1 AS store_id, 'PRODUCT' AS entity_type, user_id AS product_id, "
    "CASE WHEN event_type IN ('purchase', 'signup') THEN 'UPSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'REFRESH' END AS operation, "
    "event_id + 1 AS revision, event_type AS reason, CASE WHEN value < 0.5 THEN 'PENDING' ELSE 'COMPLETED' END AS native_state, "
    "CASE WHEN value < 1 THEN 'PENDING' ELSE 'COMPLETED' END AS hybrid_state, ts AS created_at, value FROM events")
cte("outbox_item", "SELECT event_id // 16 + 1 AS job_id, user_id % 3 + 1 AS store_id, user_id % 2 + 1 AS generation_id, "
    "CASE WHEN (event_id // 16) % 2 = 0 THEN 'PRIORITY' ELSE 'EMBEDDING' END AS lane, user_id AS product_id, event_id + 1 AS revision, "
    "event_id + 1 AS earliest_change_id, CASE (event_id // 16) % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' WHEN 4 THEN 'DEAD' ELSE 'COMPLETED' END AS state FROM events")
cte("outbox", "SELECT g + 1 AS job_id, g % 3 + 1 AS store_id, g % 2 + 1 AS generation_id, CASE WHEN g % 2 = 0 THEN 'PRIORITY' ELSE 'EMBEDDING' END AS lane, "
    "CASE g % 7 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'DEAD' WHEN 5 THEN 'CLAIMED' ELSE 'PUBLISHED' END AS state, "
    "earliest_change_id, latest_change_id, created_at, updated_at, v % 7 AS attempt_count, v % 2 AS replay_count, "
    "created_at + to_hours(CAST(v % 48 AS INTEGER)) AS claim_expires_at, CASE WHEN v % 3 = 0 THEN NULL ELSE updated_at + to_days(CAST(v % 20 AS INTEGER)) END AS next_eligible_at "
    "FROM (SELECT event_id // 16 AS g, min(event_id + 1) AS earliest_change_id, max(event_id + 1) AS latest_change_id, min(ts) AS created_at, max(ts) AS updated_at, "
    "CAST(floor(max(value)) AS BIGINT) AS v FROM events GROUP BY 1)")
cte("generations", "SELECT c_nationkey * 10 + strpos('ABFHM', substr(c_mktsegment, 1, 1)) AS generation_id, c_nationkey AS store_id, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'BUILDING' WHEN 'AUTOMOBILE' THEN 'ACTIVE' WHEN 'MACHINERY' THEN 'RETAINED' WHEN 'HOUSEHOLD' THEN 'FAILED' ELSE 'READY' END AS state, "
    "count(*) AS coverage_total, count(*) FILTER (c_acctbal > 0) AS coverage_complete, count(*) FILTER (c_acctbal < -900) AS coverage_failed, "
    "CAST(floor(max(c_acctbal)) AS BIGINT) AS captured_change_id, c_nationkey % 5 = 0 AS is_fake, "
    "CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE sha256(c_mktsegment) END AS encoder_identity_digest, c_mktsegment AS contract_digest, "
    "CASE c_nationkey % 3 WHEN 0 THEN 'RESTORED' WHEN 1 THEN 'RESTORE_FAILED' END AS refresh_state, "
    "TIMESTAMP '2024-01-01' + to_days(CAST(max(c_custkey) % 30 AS INTEGER)) AS updated_at FROM customer GROUP BY c_nationkey, c_mktsegment")
cte("store_state", "SELECT c_nationkey AS store_id, CASE WHEN c_nationkey % 4 = 3 THEN 'NATIVE' ELSE 'HYBRID' END AS activation_mode, "
    "CASE WHEN c_nationkey % 6 = 5 THEN NULL ELSE c_nationkey * 10 + 1 END AS active_generation_id, max(c_custkey) AS required_watermark, "
    "CAST(floor(max(c_acctbal)) AS BIGINT) AS native_watermark, max(c_custkey) - min(c_custkey) % 2 AS hybrid_watermark, c_nationkey % 2 = 0 AS readiness_latch "
    "FROM customer GROUP BY c_nationkey")
cte("telemetry", "SELECT ts, user_id % 3 + 1 AS store_id, CASE WHEN event_id % 2 = 0 THEN 'quick_search_container' ELSE 'graphql_product_search' END AS request_name, "
    "CASE WHEN event_type = 'error' THEN 'native_fallback' WHEN event_type IN ('click', 'view') THEN 'hybrid' ELSE 'native' END AS route, "
    "CASE WHEN event_type = 'error' THEN 'hybrid_error' WHEN event_type IN ('click', 'view') THEN 'eligible' ELSE 'known_item' END AS reason, value AS duration_ms, event_type FROM events")
cte("components", "SELECT *, 'query_encoder' AS component, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, duration_ms / 2 AS ms FROM telemetry "
    "UNION ALL SELECT *, 'native_candidates', 'success', duration_ms / 4 FROM telemetry", "telemetry")

# -- catalogue scope --
cte("stores", "SELECT n_nationkey AS store_id, n_regionkey AS website_id, n_name AS code FROM nation")
cte("product_websites", "SELECT DISTINCT l_partkey AS product_id, n_regionkey AS website_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
cte("categories", "SELECT r_regionkey + 10 AS category_id, '1/' || (r_regionkey + 10) AS path, r_name AS name FROM region UNION ALL "
    "SELECT n_nationkey + 100, '1/' || (n_regionkey + 10) || '/' || (n_nationkey + 100), n_name FROM nation")
cte("category_products", "SELECT DISTINCT l_partkey AS product_id, s_nationkey + 100 AS category_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
cte("store_products", "SELECT DISTINCT s.store_id, p.entity_id AS product_id FROM products p JOIN product_websites w ON w.product_id = p.entity_id "
    "JOIN stores s ON s.website_id = w.website_id WHERE s.store_id <> 0 AND p.status = 1 AND p.visibility IN (3, 4)", "products", "product_websites", "stores")
