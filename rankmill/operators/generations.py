"""Index generations: seeding, validation, scope changes, replacement and retention."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import canonical_json
from rankmill.operators.changes import FINISHED, append_journal
from rankmill.operators.filters import searchable
from rankmill.operators.joins import changed_keys
from rankmill.operators.ordering import dense_index
from rankmill.session import broadcast_if_small

LIVE_STATES = ("ACTIVE", "BUILDING", "CATCHING_UP", "READY")
DIGESTS = ("contract_digest", "result_contract_digest", "mapping_digest", "pipeline_digest")


def seed_batches(products: DataFrame, assignments: DataFrame, size: int) -> DataFrame:
    """(store_id, batch, items, first_product_id, last_product_id, running_total) of each store's products."""
    eligible = searchable(products, assignments).select("store_id", "product_id")
    indexed = dense_index(eligible, [F.col("store_id"), F.col("product_id")], "__place")
    starts = indexed.groupBy("store_id").agg(F.min("__place").alias("__start"))
    placed = indexed.join(broadcast_if_small(starts), "store_id").withColumn("__place", F.col("__place") - F.col("__start"))
    batches = placed.groupBy("store_id", F.floor(F.col("__place") / size).alias("batch")).agg(
        F.count(F.lit(1)).alias("items"),
        F.min("product_id").alias("first_product_id"),
        F.max("product_id").alias("last_product_id"),
    )
    # Every batch of a store but the last is full, so the running total needs no window.
    return batches.withColumn("running_total", F.col("batch") * size + F.col("items"))


def build_plan(products: DataFrame, assignments: DataFrame, dimension: int, batch_size: int, outstanding: int) -> DataFrame:
    """Workload and vector size estimates per store."""
    eligible = F.col("eligible_products")
    return (
        searchable(products, assignments).groupBy("store_id").agg(F.count(F.lit(1)).alias("eligible_products"))
        .withColumn("batches", F.ceil(eligible / batch_size).cast("long"))
        .withColumn("initial_jobs", F.least(F.col("batches"), F.lit(outstanding)))
        .withColumn("initial_items", F.least(eligible, F.col("initial_jobs") * batch_size))
        .withColumn("raw_bytes", eligible * dimension * 4)
        .withColumn("base64_bytes", eligible * (4 * ((dimension * 4 + 2) // 3)))
    )


def validate_generations(
    generations: DataFrame, snapshot: DataFrame, outbox: DataFrame, journal: DataFrame,
    products: DataFrame, assignments: DataFrame, scopes: DataFrame, contract: dict[str, str],
) -> DataFrame:
    """(generation_id, check, passed) rows for every generation in one pass.

    `snapshot` is (generation_id, store_id) per indexed document, `scopes` (store_id, digest) the
    stores' present fingerprints. Each input is aggregated by generation or store and joined on keys.
    """
    named = generations.withColumnRenamed("store_id", "g_store")
    bounds = broadcast_if_small(named.select("generation_id", "g_store", "captured_change_id"))
    boundary = F.col("captured_change_id")
    documents = snapshot.groupBy("generation_id", "store_id").agg(F.count(F.lit(1)).alias("n")).join(bounds, "generation_id").groupBy("generation_id").agg(
        F.sum("n").alias("__index"), F.sum(F.when(F.col("store_id") != F.col("g_store"), F.col("n")).otherwise(0)).alias("__foreign")
    )
    work = outbox.where(~F.col("state").isin(*FINISHED)).join(bounds, "generation_id").where(F.col("latest_change_id") <= boundary)
    work = work.groupBy("generation_id").agg(F.count(F.lit(1)).alias("__work"))
    unfinished = (F.col("native_state") != "COMPLETED") | (
        (F.col("entity_type") == "PRODUCT") & (F.col("hybrid_state") != "COMPLETED")
    )
    heads = journal.groupBy(F.col("store_id").alias("g_store")).agg(F.max("change_id").alias("__head"))
    pending = journal.where(unfinished).select(F.col("store_id").alias("g_store"), "change_id").join(bounds, "g_store")
    pending = pending.where(F.col("change_id") <= boundary).groupBy("generation_id").agg(F.count(F.lit(1)).alias("__journal"))
    coverage = searchable(products, assignments).groupBy(F.col("store_id").alias("g_store")).agg(F.count(F.lit(1)).alias("__eligible"))
    joined = named
    for side in (documents, work, pending):
        joined = joined.join(side, "generation_id", "left")
    for side in (heads, coverage, scopes.select(F.col("store_id").alias("g_store"), F.col("digest").alias("__scope"))):
        joined = joined.join(side, "g_store", "left")
    counted = joined.na.fill(0, ["__index", "__foreign", "__work", "__journal", "__head", "__eligible"])
    checks: dict[str, Column] = {d: F.col(d).eqNullSafe(F.lit(contract[d])) for d in DIGESTS}
    checks |= {
        "scope_digest": F.coalesce(F.col("scope_digest") == F.col("__scope"), F.lit(False)),
        "build_refresh_restored": F.col("refresh_state").eqNullSafe(F.lit("RESTORED")),
        "coverage_complete": F.col("coverage_complete") == F.col("coverage_total"),
        "coverage_failed": F.col("coverage_failed") == 0,
        "index_count": F.col("__index") == F.col("coverage_total"),
        "document_identity": F.col("__foreign") == 0,
        "unresolved_work": F.col("__work") == 0,
        "journal_complete": F.col("__journal") == 0,
        "catch_up_stable": (F.col("__head") == boundary) & (F.col("__eligible") == F.col("coverage_total")),
    }
    rows = F.array(
        *[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items()]
    )
    return counted.select("generation_id", F.inline(rows))


def scope_fingerprint(
    stores: DataFrame, websites: DataFrame, groups: DataFrame, settings: DataFrame,
    sources: DataFrame,
) -> DataFrame:
    """(store_id, digest) of everything that defines a store's catalogue scope.

    `settings` is (store_id, path, value), `sources` (website_id, source_code, priority, enabled);
    both hold a few rows per store.
    """
    options = settings.groupBy("store_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "value"))).alias("configuration")
    )
    stock = sources.groupBy("website_id").agg(
        F.array_sort(F.collect_list(F.struct("source_code", "priority", "enabled"))).alias("inventory")
    )
    joined = (
        stores.join(broadcast_if_small(websites), "website_id", "left")
        .join(broadcast_if_small(groups), "group_id", "left")
        .join(options, "store_id", "left")
        .join(stock, "website_id", "left")
    )
    fields = sorted(c for c in joined.columns)
    return joined.select(
        "store_id", F.sha2(canonical_json(F.struct(*fields)), 256).alias("digest")
    )


def changed_scopes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stores whose fingerprint appeared, vanished or differs."""
    return changed_keys(before, after, ["store_id"], ["digest"])


def invalidate(
    affected: DataFrame, generations: DataFrame, journal: DataFrame, outbox: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """REBUILD journal rows, failed generations and superseded jobs for changed stores.

    `affected` is (store_id, entity_type, entity_id, reason). Stores that never had a generation
    are left alone.
    """
    known = generations.select("store_id").distinct()
    rebuilds = affected.join(known, "store_id", "left_semi").distinct().withColumn(
        "operation", F.lit("REBUILD")
    )
    rows = append_journal(journal, rebuilds, ["store_id", "entity_type", "entity_id", "reason"])
    stores = rebuilds.select("store_id").distinct()
    failed = generations.where(F.col("state").isin(*LIVE_STATES)).join(
        stores, "store_id", "left_semi"
    ).withColumn("new_state", F.lit("FAILED"))
    superseded = outbox.where(~F.col("state").isin(*FINISHED)).join(
        failed.select("generation_id"), "generation_id", "left_semi"
    ).withColumn("new_state", F.lit("SUPERSEDED"))
    return rows, failed, superseded


def invalidation_impact(affected: DataFrame, generations: DataFrame, documents: DataFrame) -> DataFrame:
    """(store_id, live_generations, documents) a change would touch, without applying it."""
    stores = affected.select("store_id").distinct()
    live = generations.groupBy("store_id").agg(
        F.count_if(F.col("state").isin(*LIVE_STATES)).alias("live_generations")
    )
    sizes = documents.groupBy("store_id").agg(F.count(F.lit(1)).alias("documents"))
    return stores.join(live, "store_id").join(sizes, "store_id", "left").select(
        "store_id", "live_generations", F.coalesce("documents", F.lit(0)).alias("documents")
    )


def replacement_needed(
    stores: DataFrame, journal: DataFrame, generations: DataFrame, store_state: DataFrame
) -> DataFrame:
    """(store_id, eligible, reason, invalidation_boundary) of a replacement build."""
    pending = journal.where(
        (F.col("entity_type") == "CONFIGURATION") & (F.col("operation") == "REBUILD")
        & (F.col("hybrid_state") != "COMPLETED")
    ).groupBy("store_id").agg(F.max("change_id").alias("__invalid"))
    newest = generations.groupBy("store_id").agg(F.max("captured_change_id").alias("__newest"))
    active = store_state.where(F.col("activation_mode") == "HYBRID").join(
        generations.select(
            F.col("generation_id").alias("active_generation_id"), "is_fake",
            "encoder_identity_digest",
        ),
        "active_generation_id",
    ).select("store_id", F.lit(True).alias("__active"), "is_fake", "encoder_identity_digest")
    joined = (
        stores.select("store_id").distinct()
        .join(pending, "store_id", "left").join(newest, "store_id", "left")
        .join(active, "store_id", "left")
    )
    identity = F.coalesce(F.col("encoder_identity_digest").rlike("^[0-9a-f]{64}$"), F.lit(False))
    reason = (
        F.when(F.col("__invalid").isNull(), "no_pending_configuration_invalidation")
        .when(F.coalesce("__newest", F.lit(0)) >= F.col("__invalid"), "replacement_already_created")
        .when(F.col("__active").isNull(), "active_generation_missing")
        .when(F.col("is_fake"), "active_generation_not_production")
        .when(~identity, "active_generation_identity_missing")
        .otherwise("pending_configuration_invalidation")
    )
    return joined.select(
        "store_id",
        (reason == "pending_configuration_invalidation").alias("eligible"),
        reason.alias("reason"),
        F.coalesce("__invalid", F.lit(0)).alias("invalidation_boundary"),
    )


def retention(
    generations: DataFrame, store_state: DataFrame, dependents: dict[str, DataFrame], now: Column,
    days: int = 14,
) -> DataFrame:
    """(generation_id, protection, one column per dependent table with the rows a removal deletes).

    `dependents` maps names to tables with a generation_id column.
    """
    active = store_state.select(
        F.col("active_generation_id").alias("generation_id"), F.lit(True).alias("__active")
    ).where(F.col("generation_id").isNotNull()).distinct()
    state = F.col("state")
    fresh = F.col("updated_at") + F.make_interval(days=F.lit(days)) > now
    protection = (
        F.when(F.col("__active") | (state == "ACTIVE"), "active_generation")
        .when(state == "FAILED", "")
        .when((state == "RETAINED") & fresh, "rollback_retention_window")
        .when(state == "RETAINED", "")
        .otherwise("generation_state_not_cleanup_eligible")
    )
    out = generations.join(active, "generation_id", "left").select(
        "generation_id", "store_id", "state", protection.alias("protection")
    )
    for name, table in dependents.items():
        sizes = table.groupBy("generation_id").agg(F.count(F.lit(1)).alias(f"__{name}"))
        out = out.join(sizes, "generation_id", "left").withColumn(
            f"{name}_rows", F.coalesce(f"__{name}", F.lit(0))
        ).drop(f"__{name}")
    return out.withColumn("eligible", F.col("protection") == "")


def stores_of_websites(websites: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores of changed websites (one REBUILD each)."""
    return stores.join(websites.select("website_id").distinct(), "website_id", "left_semi").where(
        F.col("store_id") > 0
    )


