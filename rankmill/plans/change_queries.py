"""Catalogue change and generation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.operators import changes as ch
from rankmill.operators import generations as gn
from rankmill.operators import joins as jn
from rankmill.plans.oracle import with_
from rankmill.plans.registry import query

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
FINISHED = "('COMPLETED', 'SUPERSEDED')"


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def entity_products(t):
    return t.products.select(F.col("entity_id").alias("product_id"), "status", "visibility")


@query("i01_classify_changes", "store_id:i product_id:i reason:s operation:s",
       with_("journal store_products", "SELECT DISTINCT j.store_id, j.product_id, reason, CASE WHEN p.product_id IS NULL THEN 'DELETE' WHEN reason IN ('purchase', 'signup') THEN 'UPSERT' ELSE 'REFRESH' END AS operation "
             "FROM journal j LEFT JOIN store_products p ON p.store_id = j.store_id AND p.product_id = j.product_id"))
def _(t):
    changed = t.journal.select(
        "store_id", "product_id", "reason", F.col("reason").isin("purchase", "signup").alias("content")
    ).distinct()
    return ch.classify_changes(changed, entity_products(t), t.assignments)


@query(
    "i02_affected_products", "store_id:i product_id:i reason:s",
    with_("product_websites stores category_products",
          "SELECT DISTINCT s.store_id, p.product_id, x.reason FROM (SELECT l_partkey AS product_id, 'price' AS reason FROM lineitem WHERE l_discount >= 0.1 UNION "
          "SELECT product_id, 'category_rename' FROM category_products WHERE category_id IN (SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 1) UNION "
          "SELECT p_partkey, 'option_label' FROM part WHERE p_size IN (3, 4, 5) UNION SELECT l_partkey, 'inventory' FROM lineitem WHERE l_quantity = 50) x "
          "JOIN product_websites p ON p.product_id = x.product_id JOIN stores s ON s.website_id = p.website_id WHERE s.store_id <> 0"),
)
def _(t):
    def named(df, reason):
        stores = jn.product_stores(t.product_websites.join(df.select("product_id").distinct(), "product_id", "left_semi"), t.stores)
        return stores.withColumn("reason", F.lit(reason))

    lines = t.raw("lineitem").withColumnRenamed("l_partkey", "product_id")
    renamed = jn.subtree_products(
        t.categories, t.category_products, t.categories.where("category_id = 11").select(F.col("category_id").alias("root_id"))
    )
    options = jn.option_products(
        t.raw("part").selectExpr("p_partkey product_id", "cast(p_size as string) value"),
        t.raw("nation").where("n_nationkey in (3, 4, 5)").select(F.col("n_nationkey").cast("long").alias("option_id")),
    )
    return ch.affected_products(
        named(lines.where("l_discount >= 0.1"), "price"), named(renamed, "category_rename"),
        named(options, "option_label"), named(lines.where("l_quantity = 50"), "inventory"),
    )


@query("i03_append_journal", "change_id:i order_id:i",
       with_("journal", "SELECT (SELECT max(change_id) FROM journal) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS change_id, o_orderkey AS order_id FROM orders"))
def _(t):
    changes = t.raw("orders").select("o_orderdate", "o_orderkey")
    return ch.append_journal(t.journal, changes, ["o_orderdate", "o_orderkey"]).withColumnRenamed("o_orderkey", "order_id")


_WRITABLE = "SELECT store_id, generation_id FROM generations WHERE state IN ('ACTIVE', 'BUILDING', 'READY')"


def writable(t):
    return t.generations.where(F.col("state").isin("ACTIVE", "BUILDING", "READY")).select("store_id", "generation_id")


@query(
    "i04_plan_jobs", "store_id:i generation_id:i lane:s operation:s items:i earliest_change_id:i latest_change_id:i",
    with_("journal generations", f"SELECT store_id, generation_id, lane, operation, count(*) AS items, min(change_id) AS earliest_change_id, max(change_id) AS latest_change_id FROM journal JOIN ({_WRITABLE}) USING (store_id), (SELECT unnest(['PRIORITY', 'EMBEDDING']) AS lane) "
          "WHERE lane = 'PRIORITY' OR operation = 'UPSERT' GROUP BY 1, 2, 3, 4"),
)
def _(t):
    return ch.job_batches(ch.plan_jobs(t.journal, writable(t)))


_MARKED = (
    "SELECT *, CASE WHEN state NOT IN " + FINISHED + " AND revision < newest THEN 'SUPERSEDED' ELSE state END AS new_state FROM (SELECT *, max(revision) OVER (PARTITION BY store_id, generation_id, lane, product_id) AS newest FROM outbox_item)"
)


@query("i05_supersede_items", "job_id:i product_id:i revision:i new_state:s", with_("outbox_item", f"SELECT * FROM ({_MARKED})"))
def _(t):
    return ch.supersede_items(t.outbox_item)


@query(
    "i05_supersede_jobs", "job_id:i live_items:i superseded_items:i done:b earliest_change_id:i",
    with_("outbox_item", f"SELECT job_id, count(*) FILTER (new_state NOT IN {FINISHED}) AS live_items, count(*) FILTER (new_state = 'SUPERSEDED') AS superseded_items, count(*) FILTER (new_state NOT IN {FINISHED}) = 0 AS done, min(b) AS earliest_change_id FROM ("
          "SELECT *, CASE WHEN revision = newest THEN least(earliest_change_id, coalesce(inh, earliest_change_id)) ELSE earliest_change_id END AS b FROM ("
          "SELECT *, min(earliest_change_id) FILTER (new_state = 'SUPERSEDED' AND lane = 'PRIORITY') OVER (PARTITION BY store_id, generation_id, lane, product_id) AS inh FROM (" + _MARKED + "))) GROUP BY 1"),
)
def _(t):
    return ch.supersede_jobs(t.outbox_item)


@query("i05_supersede_generation", "job_id:i new_state:s",
       with_("outbox", f"SELECT job_id, CASE WHEN generation_id = 2 AND state NOT IN {FINISHED} THEN 'SUPERSEDED' ELSE state END AS new_state FROM outbox"))
def _(t):
    return ch.supersede_generation(t.outbox, [2])


_CHANGES = "SELECT store_id, product_id, value_us // 7919 AS revision, sequence, operation FROM (SELECT user_id % 3 + 1 AS store_id, user_id AS product_id, (event_id * 48271) % 65537 * 7919 AS value_us, event_id AS sequence, CASE WHEN event_type IN ('purchase', 'signup') THEN 'UPSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'REFRESH' END AS operation FROM events)"


def shuffled_changes(t):
    """Changes whose revision order is unrelated to their arrival order."""
    return t.events.selectExpr(
        "user_id % 3 + 1 store_id", "user_id product_id", "(event_id * 48271) % 65537 revision", "event_id sequence",
        "case when event_type in ('purchase', 'signup') then 'UPSERT' when event_type = 'error' then 'DELETE' else 'REFRESH' end operation",
    )


LATEST_SQL = f"SELECT * FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY revision DESC, sequence DESC) = 1"


@query("i06_latest_by_revision", "store_id:i product_id:i revision:i sequence:i operation:s", LATEST_SQL)
def _(t):
    return ch.latest_by_revision(shuffled_changes(t))


@query("i06_document_revision", "job_id:i product_id:i document_revision:i",
       with_("outbox_item", "SELECT job_id, product_id, revision * 2 + CASE WHEN lane = 'EMBEDDING' OR state = 'DEAD' THEN 2 ELSE 1 END AS document_revision FROM outbox_item"))
def _(t):
    items = t.outbox_item.withColumn("operation", F.when(F.col("state") == "DEAD", "DELETE").otherwise("UPSERT"))
    return items.withColumn("document_revision", ch.document_revision())


# Embedding saves and tombstones from events; half of the stream is already stored.
_OFFERS = (
    "SELECT user_id % 3 + 1 AS store_id, user_id AS product_id, user_id % 2 + 1 AS generation_id, event_id // 200 AS revision, event_id AS sequence, "
    "CASE WHEN event_type = 'error' THEN 'DELETED' ELSE 'COMPLETE' END AS status, sha256(event_type) AS source_hash FROM events"
)
_STORE = f"SELECT * FROM ({_OFFERS}) WHERE revision % 2 = 0 QUALIFY row_number() OVER (PARTITION BY store_id, product_id, generation_id ORDER BY revision DESC, status = 'DELETED' DESC, sequence) = 1"
_INCOMING = f"SELECT * FROM ({_OFFERS}) WHERE revision % 2 = 1 OR revision % 5 = 0"
_APPLIED = (
    f"SELECT store_id, product_id, generation_id, revision, status, CASE WHEN status = 'DELETED' THEN sha256('DELETED') ELSE source_hash END AS source_hash, seq >= 0 AS changed, prev FROM ("
    f"SELECT *, max(CASE WHEN seq = -1 THEN status END) OVER (PARTITION BY store_id, product_id, generation_id) AS prev FROM ("
    f"SELECT store_id, product_id, generation_id, revision, status, source_hash, -1 AS seq FROM ({_STORE}) UNION ALL SELECT store_id, product_id, generation_id, revision, status, source_hash, sequence FROM ({_INCOMING})) "
    "QUALIFY row_number() OVER (PARTITION BY store_id, product_id, generation_id ORDER BY revision DESC, status = 'DELETED' DESC, seq) = 1 OR seq = -1) "
    "QUALIFY row_number() OVER (PARTITION BY store_id, product_id, generation_id ORDER BY revision DESC, status = 'DELETED' DESC, seq) = 1"
)


def offers(t):
    return t.events.selectExpr(
        "user_id % 3 + 1 store_id", "user_id product_id", "user_id % 2 + 1 generation_id", "event_id div 200 revision",
        "event_id sequence", "if(event_type = 'error', 'DELETED', 'COMPLETE') status", "sha2(event_type, 256) source_hash",
        "cast(event_type as binary) vector",
    )


def store_and_incoming(t):
    empty = offers(t).where("false")
    stored = ch.apply_embeddings(empty, offers(t).where("revision % 2 = 0"))
    return stored, offers(t).where("revision % 2 = 1 or revision % 5 = 0")


@query("i07_apply_embeddings", "store_id:i product_id:i generation_id:i revision:i status:s source_hash:s changed:b", _APPLIED)
def _(t):
    return ch.apply_embeddings(*store_and_incoming(t))


@query("i07_coverage_delta", "generation_id:i delta:i",
       f"SELECT generation_id, sum(CASE WHEN status = 'COMPLETE' THEN 1 ELSE 0 END - CASE WHEN coalesce(prev, '') = 'COMPLETE' THEN 1 ELSE 0 END) AS delta FROM ({_APPLIED}) GROUP BY 1")
def _(t):
    return ch.coverage_delta(ch.apply_embeddings(*store_and_incoming(t)))


@query("i07_embedding_conflicts", "store_id:i product_id:i generation_id:i revision:i source_hash:s",
       f"SELECT i.store_id, i.product_id, i.generation_id, i.revision, i.source_hash FROM ({_INCOMING}) i JOIN ({_APPLIED}) a ON a.store_id = i.store_id AND a.product_id = i.product_id AND a.generation_id = i.generation_id AND a.revision = i.revision "
       "WHERE a.status = 'COMPLETE' AND i.status = 'COMPLETE' AND i.source_hash <> a.source_hash")
def _(t):
    return ch.embedding_conflicts(*store_and_incoming(t))


@query(
    "i08_apply_tombstones", "store_id:i product_id:i generation_id:i revision:i status:s",
    f"SELECT s.store_id, s.product_id, s.generation_id, CASE WHEN d.r >= s.revision THEN d.r ELSE s.revision END AS revision, CASE WHEN d.r >= s.revision THEN 'DELETED' ELSE s.status END AS status FROM ({_STORE}) s LEFT JOIN "
    f"(SELECT store_id, product_id, generation_id, max(revision) AS r FROM ({_OFFERS}) WHERE status = 'DELETED' AND revision % 2 = 1 GROUP BY 1, 2, 3) d USING (store_id, product_id, generation_id)",
)
def _(t):
    stored, _incoming = store_and_incoming(t)
    return ch.apply_tombstones(stored, offers(t).where("status = 'DELETED' and revision % 2 = 1"))


@query(
    "i09_to_encode", "cache_key:s documents:i first_product_id:i",
    f"SELECT sha256(hash_in) AS cache_key, count(*) AS documents, min(product_id) AS first_product_id FROM (SELECT DISTINCT user_id % 3 + 1 AS store_id, user_id AS product_id, user_id % 2 + 1 AS generation_id, event_type AS hash_in FROM events) d "
    f"WHERE NOT EXISTS (SELECT 1 FROM ({_STORE}) s WHERE s.store_id = d.store_id AND s.product_id = d.product_id AND s.generation_id = d.generation_id AND s.status = 'COMPLETE' AND s.source_hash = sha256(d.hash_in)) GROUP BY 1",
)
def _(t):
    stored, _incoming = store_and_incoming(t)
    documents = offers(t).select(*ch.EMBEDDING_KEY, F.sha2(F.col("vector"), 256).alias("source_hash")).distinct().withColumn("cache_key", F.col("source_hash"))
    return ch.to_encode(documents, stored)


def _watermark(side: str) -> str:
    return (
        f"SELECT j.store_id, coalesce(max(change_id) FILTER ({side} = 'COMPLETED' AND (f IS NULL OR change_id < f)), 0) AS watermark FROM journal j LEFT JOIN "
        f"(SELECT store_id, min(change_id) AS f FROM journal WHERE {side} <> 'COMPLETED' GROUP BY 1) p USING (store_id) GROUP BY 1"
    )


@query("i10_safe_watermark", "side:s store_id:i watermark:i",
       with_("journal", f"SELECT 'hybrid' AS side, * FROM ({_watermark('hybrid_state')}) UNION ALL SELECT 'native', * FROM ({_watermark('native_state')})"))
def _(t):
    return ch.safe_watermark(t.journal, "hybrid_state").withColumn("side", F.lit("hybrid")).unionByName(
        ch.safe_watermark(t.journal, "native_state").withColumn("side", F.lit("native"))
    )


READY = (
    "SELECT store_id, activation_mode, active_generation_id, activation_mode = 'HYBRID' AND active_generation_id IS NOT NULL AND readiness_latch AND native_watermark >= required_watermark AND hybrid_watermark >= required_watermark AS ready, "
    "greatest(0, required_watermark - native_watermark) AS native_lag, greatest(0, required_watermark - hybrid_watermark) AS hybrid_lag FROM store_state"
)


@query("i11_readiness", "store_id:i ready:b native_lag:i hybrid_lag:i", with_("store_state", READY))
def _(t):
    return ch.readiness(t.store_state)


@query("i12_resolved_changes", "store_id:i change_id:i",
       with_("journal outbox", "SELECT j.store_id, j.change_id FROM journal j JOIN outbox o ON o.store_id = j.store_id AND o.lane = 'PRIORITY' AND j.change_id BETWEEN o.earliest_change_id AND o.latest_change_id WHERE hybrid_state <> 'COMPLETED' GROUP BY 1, 2 "
             f"HAVING count(*) FILTER (state = 'COMPLETED') > 0 AND count(*) FILTER (state NOT IN {FINISHED}) = 0"))
def _(t):
    return ch.resolved_changes(t.journal, t.outbox)


@query("i13_acknowledge", "change_id:i native_state:s",
       with_("journal", "SELECT change_id, CASE WHEN change_id <= store_id * 2000 AND product_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'COMPLETED' ELSE native_state END AS native_state FROM journal"))
def _(t):
    boundaries = t.journal.select("store_id").distinct().withColumn("boundary", F.col("store_id") * 2000)
    products = t.raw("customer").where("c_acctbal > 0").selectExpr("c_custkey product_id")
    return ch.acknowledge(t.journal, boundaries, products)


@query("i13_untracked", "store_id:i product_id:i",
       with_("journal", "SELECT DISTINCT store_id, product_id FROM journal WHERE (store_id, product_id) NOT IN (SELECT store_id, product_id FROM journal WHERE native_state <> 'COMPLETED')"))
def _(t):
    return ch.untracked(t.journal, t.journal.select("store_id", "product_id"))


_RECONCILED = f"SELECT *, CASE WHEN (state = 'CLAIMED' AND claim_expires_at < {NOW}) OR (state = 'PUBLISHED' AND updated_at < {NOW} - INTERVAL 5 MINUTE) THEN 'TIMED_OUT' ELSE state END AS new_state FROM outbox"


@query("i14_reconcile", "job_id:i new_state:s", with_("outbox", _RECONCILED))
def _(t):
    return ch.reconcile(t.outbox, now())


@query("i14_work_queue", "job_id:i new_state:s",
       with_("outbox", f"SELECT job_id, new_state FROM ({_RECONCILED}) WHERE new_state IN ('PENDING', 'RETRY', 'TIMED_OUT') AND (next_eligible_at IS NULL OR next_eligible_at <= {NOW}) ORDER BY created_at, job_id LIMIT 100"))
def _(t):
    return ch.work_queue(t.outbox, now())


@query("i14_after_failure", "job_id:i new_state:s",
       with_("outbox", "SELECT job_id, CASE WHEN attempt_count >= 5 THEN 'DEAD' ELSE 'RETRY' END AS new_state FROM outbox WHERE state = 'CLAIMED'"))
def _(t):
    return ch.after_failure(t.outbox)


@query("i14_manual_replay", "job_id:i state:s attempt_count:i replay_count:i",
       with_("outbox", "SELECT job_id, 'PENDING' AS state, 0 AS attempt_count, replay_count + 1 AS replay_count FROM outbox WHERE state IN ('PUBLISHED', 'RETRY', 'TIMED_OUT', 'DEAD')"))
def _(t):
    return ch.manual_replay(t.outbox)


@query("i15_seed_batches", "store_id:i batch:i items:i first_product_id:i last_product_id:i running_total:i",
       with_("store_products", "SELECT store_id, batch, count(*) AS items, min(product_id) AS first_product_id, max(product_id) AS last_product_id, max(p) + 1 AS running_total FROM "
             "(SELECT *, p // 64 AS batch FROM (SELECT store_id, product_id, row_number() OVER (PARTITION BY store_id ORDER BY product_id) - 1 AS p FROM store_products)) GROUP BY 1, 2"))
def _(t):
    return gn.seed_batches(entity_products(t), t.assignments, 64)


@query("i16_build_plan", "store_id:i eligible_products:i batches:i initial_jobs:i initial_items:i raw_bytes:i base64_bytes:i",
       with_("store_products", "SELECT store_id, n AS eligible_products, (n + 63) // 64 AS batches, least((n + 63) // 64, 8) AS initial_jobs, least(n, 8 * 64) AS initial_items, n * 1024 AS raw_bytes, n * 1368 AS base64_bytes FROM (SELECT store_id, count(*) AS n FROM store_products GROUP BY 1)"))
def _(t):
    return gn.build_plan(entity_products(t), t.assignments, 256, 64, 8)


CONTRACT = {"contract_digest": "AUTOMOBILE"}
_CHECKS = (
    "contract_digest", "result_contract_digest", "mapping_digest", "pipeline_digest", "scope_digest", "build_refresh_restored", "coverage_complete",
    "coverage_failed", "index_count", "document_identity", "unresolved_work", "journal_complete", "catch_up_stable",
)


@query(
    "i17_validate_generation", "generation_id:i check:s passed:b",
    with_("generations journal outbox products store_products",
          f"SELECT generation_id, unnest({list(_CHECKS)}) AS check, "
          "unnest([contract_digest = 'AUTOMOBILE', true, true, false, generation_id % 2 = 0, coalesce(refresh_state = 'RESTORED', false), coverage_complete = coverage_total, coverage_failed = 0, "
          "coalesce(indexed, 0) = coverage_total, coalesce(elsewhere, 0) = 0, coalesce(work, 0) = 0, coalesce(jr, 0) = 0, coalesce(head, 0) = captured_change_id AND coalesce(elig, 0) = coverage_total]) AS passed "
          "FROM generations g "
          "LEFT JOIN (SELECT (p_partkey % 25) * 10 + p_size % 5 + 1 AS generation_id, count(*) AS indexed, count(*) FILTER (p_size % 7 <> 0 AND p_partkey % 25 <> 0) AS elsewhere FROM part GROUP BY 1) USING (generation_id) "
          f"LEFT JOIN (SELECT g.generation_id, count(*) AS work FROM outbox o JOIN generations g ON g.generation_id = (o.job_id % 25) * 10 + o.job_id % 5 + 1 AND o.latest_change_id <= g.captured_change_id WHERE o.state NOT IN {FINISHED} GROUP BY 1) USING (generation_id) "
          "LEFT JOIN (SELECT g.generation_id, count(*) AS jr FROM journal j JOIN generations g ON g.store_id = j.store_id AND j.change_id <= g.captured_change_id WHERE native_state <> 'COMPLETED' OR hybrid_state <> 'COMPLETED' GROUP BY 1) USING (generation_id) "
          "LEFT JOIN (SELECT store_id, max(change_id) AS head FROM journal GROUP BY 1) USING (store_id) LEFT JOIN (SELECT store_id, count(*) AS elig FROM store_products GROUP BY 1) USING (store_id)"),
)
def _(t):
    current = scopes(t)
    generations = t.generations.join(current, "store_id", "left").select(
        "generation_id", "store_id", "captured_change_id", "coverage_total", "coverage_complete", "coverage_failed", "contract_digest", "refresh_state",
        F.lit("r").alias("result_contract_digest"), F.lit("m").alias("mapping_digest"), F.lit("p").alias("pipeline_digest"),
        F.when(F.col("generation_id") % 2 == 0, F.col("digest")).otherwise("stale").alias("scope_digest"),
    )
    snapshot = t.raw("part").selectExpr(
        "p_partkey % 25 * 10 + p_size % 5 + 1 generation_id", "if(p_size % 7 = 0, p_partkey % 25, 0) store_id"
    )
    outbox = t.outbox.withColumn("generation_id", F.col("job_id") % 25 * 10 + F.col("job_id") % 5 + 1)
    contract = {"contract_digest": "AUTOMOBILE", "result_contract_digest": "r", "mapping_digest": "m", "pipeline_digest": "other"}
    return gn.validate_generations(generations, snapshot, outbox, t.journal, entity_products(t), t.assignments, current, contract)


_SCOPE = (
    "SELECT n_nationkey AS store_id, sha256('{\"code\":\"' || n_name || '\",\"configuration\":[' || string_agg('{\"path\":\"' || path || '\",\"value\":\"' || v || '\"}', ',' ORDER BY path) || '],\"group_code\":\"g' || (n_nationkey % 4) || '\",\"group_id\":' || (n_nationkey % 4) || "
    "',\"inventory\":' || inv || ',\"store_id\":' || n_nationkey || ',\"website_code\":\"' || r_name || '\",\"website_id\":' || n_regionkey || '}') AS digest FROM nation JOIN region ON n_regionkey = r_regionkey "
    "JOIN (SELECT c_nationkey, c_mktsegment AS path, CAST(count(*) AS VARCHAR) AS v FROM customer GROUP BY 1, 2) ON c_nationkey = n_nationkey "
    "JOIN (SELECT r, '[' || string_agg('{\"source_code\":\"' || code || '\",\"priority\":' || pr || ',\"enabled\":' || en || '}', ',' ORDER BY code) || ']' AS inv FROM (SELECT n_regionkey AS r, s_name AS code, s_suppkey AS pr, CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END AS en FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1) ON r = n_regionkey "
    "GROUP BY n_nationkey, n_name, r_name, n_regionkey, inv"
)


def scopes(t, customers=None):
    stores = t.stores.withColumn("group_id", F.col("store_id") % 4)
    websites = t.raw("region").selectExpr("cast(r_regionkey as bigint) website_id", "r_name website_code")
    groups = stores.select("group_id").distinct().withColumn("group_code", F.concat(F.lit("g"), "group_id"))
    settings = (t.raw("customer") if customers is None else customers).groupBy(
        F.col("c_nationkey").cast("long").alias("store_id"), F.col("c_mktsegment").alias("path")
    ).agg(F.count(F.lit(1)).cast("string").alias("value"))
    sources = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "cast(n_regionkey as bigint) website_id", "s_name source_code", "s_suppkey priority", "s_acctbal > 0 enabled"
    )
    return gn.scope_fingerprint(stores, websites, groups, settings, sources)


@query("i18_scope_fingerprint", "store_id:i digest:s", _SCOPE)
def _(t):
    return scopes(t)


@query("i18_changed_scopes", "store_id:i change:s",
       "SELECT DISTINCT c_nationkey AS store_id, 'changed' AS change FROM customer WHERE c_acctbal > 9900")
def _(t):
    return gn.changed_scopes(scopes(t), scopes(t, t.raw("customer").where("c_acctbal <= 9900")))


_AFFECTED = "SELECT n_nationkey AS store_id, 'INVENTORY_STOCK' AS entity_type, n_regionkey AS entity_id, 'stock_link_change' AS reason FROM nation WHERE n_regionkey = 1 AND n_nationkey > 0"


def affected(t):
    websites = t.raw("region").where("r_regionkey = 1").selectExpr("cast(r_regionkey as bigint) website_id")
    return gn.stores_of_websites(websites, t.stores).selectExpr(
        "store_id", "'INVENTORY_STOCK' entity_type", "website_id entity_id", "'stock_link_change' reason"
    )


_LIVE = "('ACTIVE', 'BUILDING', 'CATCHING_UP', 'READY')"


@query(
    "i19_invalidate", "kind:s id:i state:s",
    with_("journal generations outbox", f"SELECT 'journal' AS kind, (SELECT max(change_id) FROM journal) + row_number() OVER (ORDER BY store_id) AS id, 'REBUILD' AS state FROM ({_AFFECTED}) UNION ALL "
          f"SELECT 'generation', generation_id, 'FAILED' FROM generations WHERE state IN {_LIVE} AND store_id IN (SELECT store_id FROM ({_AFFECTED})) UNION ALL "
          f"SELECT 'job', job_id, 'SUPERSEDED' FROM outbox WHERE state NOT IN {FINISHED} AND generation_id * 10 + 1 IN (SELECT generation_id FROM generations WHERE state IN {_LIVE} AND store_id IN (SELECT store_id FROM ({_AFFECTED})))"),
)
def _(t):
    jobs = t.outbox.withColumn("generation_id", F.col("generation_id") * 10 + 1)
    rows, failed, superseded = gn.invalidate(affected(t), t.generations, t.journal, jobs)
    return (
        rows.selectExpr("'journal' kind", "change_id id", "operation state")
        .unionByName(failed.selectExpr("'generation' kind", "generation_id id", "new_state state"))
        .unionByName(superseded.selectExpr("'job' kind", "job_id id", "new_state state"))
    )


@query("i19_invalidation_impact", "store_id:i live_generations:i documents:i",
       with_("generations", f"SELECT store_id, live_generations, coalesce(n, 0) AS documents FROM ({_AFFECTED}) JOIN (SELECT store_id, count(*) FILTER (state IN {_LIVE}) AS live_generations FROM generations GROUP BY 1) USING (store_id) LEFT JOIN (SELECT p_size AS store_id, count(*) AS n FROM part GROUP BY 1) USING (store_id)"))
def _(t):
    documents = t.raw("part").selectExpr("cast(p_size as bigint) store_id")
    return gn.invalidation_impact(affected(t), t.generations, documents)


_REBUILDS = "SELECT user_id % 25 AS store_id, event_id + 1 AS change_id, CASE WHEN event_type = 'error' THEN 'REBUILD' ELSE 'UPSERT' END AS operation, CASE WHEN value < 5 THEN 'PENDING' ELSE 'COMPLETED' END AS hybrid_state FROM events"


@query(
    "i20_replacement_needed", "store_id:i eligible:b reason:s invalidation_boundary:i",
    with_("generations store_state stores", "SELECT store_id, reason = 'pending_configuration_invalidation' AS eligible, reason, coalesce(inv, 0) AS invalidation_boundary FROM (SELECT s.store_id, inv, CASE WHEN inv IS NULL THEN 'no_pending_configuration_invalidation' WHEN coalesce(newest, 0) >= inv THEN 'replacement_already_created' WHEN a.store_id IS NULL THEN 'active_generation_missing' "
          "WHEN a.is_fake THEN 'active_generation_not_production' WHEN a.encoder_identity_digest IS NULL THEN 'active_generation_identity_missing' ELSE 'pending_configuration_invalidation' END AS reason FROM stores s "
          f"LEFT JOIN (SELECT store_id, max(change_id) AS inv FROM ({_REBUILDS}) WHERE operation = 'REBUILD' AND hybrid_state = 'PENDING' GROUP BY 1) i ON i.store_id = s.store_id LEFT JOIN (SELECT store_id, max(captured_change_id) // 2 AS newest FROM generations GROUP BY 1) n ON n.store_id = s.store_id "
          "LEFT JOIN (SELECT st.store_id, g.is_fake, g.encoder_identity_digest FROM store_state st JOIN generations g ON g.generation_id = st.active_generation_id WHERE activation_mode = 'HYBRID') a ON a.store_id = s.store_id)"),
)
def _(t):
    journal = t.events.selectExpr(
        "user_id % 25 store_id", "event_id + 1 change_id", "'CONFIGURATION' entity_type",
        "if(event_type = 'error', 'REBUILD', 'UPSERT') operation", "if(value < 5, 'PENDING', 'COMPLETED') hybrid_state",
    )
    generations = t.generations.withColumn("captured_change_id", F.floor(F.col("captured_change_id") / 2))
    return gn.replacement_needed(t.stores, journal, generations, t.store_state)


@query(
    "i21_retention", "generation_id:i state:s protection:s outbox_rows:i embedding_rows:i eligible:b",
    with_("generations store_state outbox", "SELECT g.generation_id, g.state, p AS protection, coalesce(o, 0) AS outbox_rows, coalesce(e, 0) AS embedding_rows, p = '' AS eligible FROM (SELECT *, CASE WHEN generation_id IN (SELECT active_generation_id FROM store_state WHERE active_generation_id IS NOT NULL) OR state = 'ACTIVE' THEN 'active_generation' WHEN state = 'FAILED' THEN '' "
          f"WHEN state = 'RETAINED' AND updated_at + INTERVAL 14 DAY > {NOW} THEN 'rollback_retention_window' WHEN state = 'RETAINED' THEN '' ELSE 'generation_state_not_cleanup_eligible' END AS p FROM generations) g "
          "LEFT JOIN (SELECT generation_id, count(*) AS o FROM outbox GROUP BY 1) USING (generation_id) LEFT JOIN (SELECT user_id AS generation_id, count(*) AS e FROM events GROUP BY 1) USING (generation_id)"),
)
def _(t):
    dependents = {"outbox": t.outbox, "embedding": t.events.selectExpr("user_id generation_id")}
    return gn.retention(t.generations, t.store_state, dependents, now())
