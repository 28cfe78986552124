"""Catalogue changes: journal, work items, embedding store and watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.filters import searchable
from rankmill.operators.joins import changes_in_jobs
from rankmill.operators.ordering import dense_index
from rankmill.session import broadcast_if_small

COMPLETED = "COMPLETED"
FINISHED = ("COMPLETED", "SUPERSEDED")
EMBEDDING_KEY = ("store_id", "product_id", "generation_id")


def classify_changes(changed: DataFrame, products: DataFrame, assignments: DataFrame) -> DataFrame:
    """(store_id, product_id, reason, operation): products eligible in the store are upserted, others deleted.

    `changed` is (store_id, product_id, reason, content): rows with `content` false (price or stock
    only) refresh the document and keep its vector. `assignments` is (store_id, product_id).
    """
    eligible = searchable(products, assignments).select("store_id", "product_id", F.lit(True).alias("__eligible"))
    return changed.join(eligible, ["store_id", "product_id"], "left").select(
        "store_id", "product_id", "reason",
        F.when(F.col("__eligible").isNull(), "DELETE")
        .when(F.col("content"), "UPSERT")
        .otherwise("REFRESH").alias("operation"),
    )


def affected_products(*sources: DataFrame) -> DataFrame:
    """(store_id, product_id, reason) of all change sources, each once."""
    columns = ["store_id", "product_id", "reason"]
    rows = sources[0].select(*columns)
    for source in sources[1:]:
        rows = rows.unionByName(source.select(*columns))
    return rows.distinct()


def append_journal(journal: DataFrame, changes: DataFrame, order: Sequence[str]) -> DataFrame:
    """New journal rows with ids that continue the journal without gaps, in `order`."""
    last = journal.agg(F.coalesce(F.max("change_id"), F.lit(0)).alias("__last"))
    indexed = dense_index(changes, [F.col(c) for c in order], "__place")
    return (
        indexed.join(F.broadcast(last))  # one row
        .withColumn("change_id", F.col("__last") + F.col("__place") + 1)
        .withColumn("revision", F.col("change_id"))
        .withColumn("native_state", F.lit("PENDING"))
        .withColumn("hybrid_state", F.lit("PENDING"))
        .drop("__last", "__place")
    )


def plan_jobs(changes: DataFrame, generations: DataFrame) -> DataFrame:
    """One row per job item: a PRIORITY lane for every change, EMBEDDING for content upserts only.

    `generations` is (store_id, generation_id) of the writable ones.
    """
    lanes = F.when(
        F.col("operation") == "UPSERT", F.array(F.lit("PRIORITY"), F.lit("EMBEDDING"))
    ).otherwise(F.array(F.lit("PRIORITY")))
    return (
        changes.join(broadcast_if_small(generations), "store_id")
        .withColumn("lane", F.explode(lanes))
        .select("store_id", "generation_id", "lane", "operation", "product_id", "change_id")
    )


def job_batches(items: DataFrame) -> DataFrame:
    """Jobs per (store, generation, lane, operation): items and their change boundary."""
    return items.groupBy("store_id", "generation_id", "lane", "operation").agg(
        F.count(F.lit(1)).alias("items"),
        F.min("change_id").alias("earliest_change_id"),
        F.max("change_id").alias("latest_change_id"),
    )


# -- superseding ---------------------------------------------------------------------------------

ITEM_KEY = ("store_id", "generation_id", "lane", "product_id")


def _live(state: Column) -> Column:
    return ~state.isin(*FINISHED)


def supersede_items(items: DataFrame) -> DataFrame:
    """Items with `new_state`: an unfinished item below the newest revision of its key is superseded.

    Aggregate and join back instead of a window: a product with very many items is
    pre-aggregated and its join partition can be split.
    """
    newest = items.groupBy(*ITEM_KEY).agg(F.max("revision").alias("__newest"))
    return items.join(newest, list(ITEM_KEY)).withColumn(
        "new_state",
        F.when(
            _live(F.col("state")) & (F.col("revision") < F.col("__newest")), "SUPERSEDED"
        ).otherwise(F.col("state")),
    )


def supersede_jobs(items: DataFrame) -> DataFrame:
    """(job_id, live_items, superseded_items, done, earliest_change_id) after superseding.

    A PRIORITY job that replaces older items also covers their change range.
    """
    marked = supersede_items(items)
    gone = (F.col("new_state") == "SUPERSEDED") & (F.col("state") != "SUPERSEDED")
    inherited = (
        marked.where(gone & (F.col("lane") == "PRIORITY"))
        .groupBy(*ITEM_KEY)
        .agg(F.min("earliest_change_id").alias("__inherited"))
    )
    covering = marked.join(inherited, list(ITEM_KEY), "left").withColumn(
        "__boundary",
        F.when(
            F.col("revision") == F.col("__newest"),
            F.least("earliest_change_id", F.coalesce("__inherited", "earliest_change_id")),
        ).otherwise(F.col("earliest_change_id")),
    )
    return covering.groupBy("job_id").agg(
        F.count_if(_live(F.col("new_state"))).alias("live_items"),
        F.count_if(gone).alias("superseded_items"),
        (F.count_if(_live(F.col("new_state"))) == 0).alias("done"),
        F.min("__boundary").alias("earliest_change_id"),
    )


def supersede_generation(jobs: DataFrame, generation_ids: Sequence[int]) -> DataFrame:
    """Jobs with `new_state`: every unfinished job of the given generations is superseded."""
    return jobs.withColumn(
        "new_state",
        F.when(
            F.col("generation_id").isin(*generation_ids) & _live(F.col("state")), "SUPERSEDED"
        ).otherwise(F.col("state")),
    )


# -- revisions and embeddings --------------------------------------------------------------------

def document_revision() -> Column:
    """Odd revisions for priority writes, the even one above for embeddings and deletes."""
    late = (F.col("lane") == "EMBEDDING") | (F.col("operation") == "DELETE")
    return F.col("revision") * 2 + F.when(late, 2).otherwise(1)


def latest_by_revision(
    events: DataFrame, keys: Sequence[str] = ("store_id", "product_id"), sequence: str = "sequence"
) -> DataFrame:
    """The row that wins per key: highest revision, the later arrival among equals."""
    rest = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("revision", sequence))
    return events.groupBy(*keys).agg(newest.alias("__row")).select(*keys, "__row.*")


def _incoming(rows: DataFrame, sequence: Column) -> DataFrame:
    return rows.select(
        *EMBEDDING_KEY, "revision", "status", "source_hash", "vector", sequence.alias("__seq")
    )


def _offers(store: DataFrame, incoming: DataFrame) -> DataFrame:
    stored = _incoming(store, F.lit(-1).cast("long"))
    return stored.unionByName(_incoming(incoming, F.col("sequence").cast("long")))


def apply_embeddings(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after a batch of saves (COMPLETE) and tombstones (DELETED).

    Higher revisions win, a tombstone beats a save of its revision, and of equal saves the stored
    or first one stays. All of that is one ordering, so it is one aggregate per key. Rows carry
    the earlier status for `coverage_delta`.
    """
    order = F.struct(
        "revision", (F.col("status") == "DELETED").cast("int").alias("d"), (-F.col("__seq")).alias("s")
    )
    won = F.max_by(F.struct("revision", "status", "source_hash", "vector", "__seq"), order)
    before = F.max(F.when(F.col("__seq") == -1, F.col("status")))
    merged = _offers(store, incoming).groupBy(*EMBEDDING_KEY).agg(
        won.alias("__won"), before.alias("previous_status")
    )
    deleted = F.col("__won.status") == "DELETED"
    return merged.select(
        *EMBEDDING_KEY,
        F.col("__won.revision").alias("revision"),
        F.col("__won.status").alias("status"),
        F.when(deleted, F.sha2(F.lit("DELETED"), 256)).otherwise(F.col("__won.source_hash")).alias("source_hash"),
        F.when(~deleted, F.col("__won.vector")).alias("vector"),
        "previous_status",
        (F.col("__won.__seq") >= 0).alias("changed"),
    )


def embedding_conflicts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Saves whose revision equals the surviving save's but whose source differs (error rows)."""
    survivors = apply_embeddings(store, incoming).where(F.col("status") == "COMPLETE").select(
        *EMBEDDING_KEY, "revision", F.col("source_hash").alias("__kept")
    )
    return (
        incoming.where(F.col("status") == "COMPLETE")
        .select(*EMBEDDING_KEY, "revision", "source_hash")
        .join(survivors, [*EMBEDDING_KEY, "revision"])
        .where(F.col("source_hash") != F.col("__kept"))
        .select(*EMBEDDING_KEY, "revision", "source_hash", F.col("__kept").alias("kept_hash"))
    )


def apply_tombstones(store: DataFrame, deletes: DataFrame) -> DataFrame:
    """`apply_embeddings` for (key, revision, sequence) deletions."""
    rows = deletes.select(
        *EMBEDDING_KEY, "revision", F.lit("DELETED").alias("status"),
        F.sha2(F.lit("DELETED"), 256).alias("source_hash"),
        F.lit(None).cast(store.schema["vector"].dataType).alias("vector"), "sequence",
    )
    return apply_embeddings(store, rows)


def coverage_delta(applied: DataFrame) -> DataFrame:
    """(generation_id, delta): completed embeddings gained or lost by a batch."""
    was = F.coalesce(F.col("previous_status") == "COMPLETE", F.lit(False)).cast("int")
    now = (F.col("status") == "COMPLETE").cast("int")
    return applied.groupBy("generation_id").agg(F.sum(now - was).cast("long").alias("delta"))


def to_encode(documents: DataFrame, store: DataFrame) -> DataFrame:
    """Documents without a stored vector for the same source, one per distinct input.

    `documents` is (store_id, product_id, generation_id, source_hash, cache_key).
    """
    reusable = store.where(F.col("status") == "COMPLETE").select(*EMBEDDING_KEY, "source_hash")
    missing = documents.join(reusable, [*EMBEDDING_KEY, "source_hash"], "left_anti")
    return missing.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("documents"), F.min("product_id").alias("first_product_id")
    )


# -- watermarks ----------------------------------------------------------------------------------

def safe_watermark(journal: DataFrame, side: str = "hybrid_state") -> DataFrame:
    """(store_id, watermark): largest completed id below the store's first pending one, or 0."""
    done = F.col(side) == COMPLETED
    pending = journal.where(~done).groupBy("store_id").agg(F.min("change_id").alias("__first"))
    return (
        journal.select("store_id", "change_id", done.alias("__done"))
        .join(broadcast_if_small(pending), "store_id", "left")
        .groupBy("store_id")
        .agg(
            F.coalesce(
                F.max(
                    F.when(
                        F.col("__done")
                        & (F.col("__first").isNull() | (F.col("change_id") < F.col("__first"))),
                        F.col("change_id"),
                    )
                ),
                F.lit(0),
            ).alias("watermark")
        )
    )


def readiness(store_state: DataFrame) -> DataFrame:
    """Ready flag and lags per store."""
    required = F.col("required_watermark")
    caught_up = (F.col("native_watermark") >= required) & (F.col("hybrid_watermark") >= required)
    return store_state.select(
        "store_id", "activation_mode", "active_generation_id",
        (
            (F.col("activation_mode") == "HYBRID")
            & F.col("active_generation_id").isNotNull()
            & F.col("readiness_latch") & caught_up
        ).alias("ready"),
        F.greatest(F.lit(0), required - F.col("native_watermark")).alias("native_lag"),
        F.greatest(F.lit(0), required - F.col("hybrid_watermark")).alias("hybrid_lag"),
    )


def resolved_changes(journal: DataFrame, outbox: DataFrame) -> DataFrame:
    """Pending changes inside a completed PRIORITY job that no unresolved PRIORITY job covers."""
    priority = outbox.where(F.col("lane") == "PRIORITY").select(
        "store_id", "earliest_change_id", "latest_change_id", "state"
    )
    pending = journal.where(F.col("hybrid_state") != COMPLETED).select("store_id", "change_id")
    covered = changes_in_jobs(pending, priority)
    return covered.groupBy("store_id", "change_id").agg(
        F.count_if(F.col("state") == COMPLETED).alias("__done"),
        F.count_if(~F.col("state").isin(*FINISHED)).alias("__open"),
    ).where((F.col("__done") > 0) & (F.col("__open") == 0)).select("store_id", "change_id")


def untracked(journal: DataFrame, candidates: DataFrame) -> DataFrame:
    """(store_id, product_id) candidates with no pending native change of their own."""
    open_changes = journal.where(F.col("native_state") != COMPLETED).select("store_id", "product_id").distinct()
    return candidates.distinct().join(open_changes, ["store_id", "product_id"], "left_anti")


def acknowledge(journal: DataFrame, boundaries: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Journal with native changes up to each store's boundary completed.

    `boundaries` is (store_id, boundary); `products` (product_id) limits it to those products.
    """
    joined = journal.join(broadcast_if_small(boundaries), "store_id", "left")
    hit = F.coalesce(F.col("change_id") <= F.col("boundary"), F.lit(False))
    if products is not None:
        marked = products.select("product_id").distinct().withColumn("__named", F.lit(True))
        joined = joined.join(marked, "product_id", "left")
        hit = hit & F.coalesce("__named", F.lit(False))
    return joined.withColumn(
        "native_state", F.when(hit, COMPLETED).otherwise(F.col("native_state"))
    ).select(*journal.columns)


# -- work queue ----------------------------------------------------------------------------------

def reconcile(outbox: DataFrame, now: Column, publish_minutes: int = 5) -> DataFrame:
    """Outbox with `new_state`: expired claims and stale publications time out."""
    expired = (F.col("state") == "CLAIMED") & (F.col("claim_expires_at") < now)
    stale = (F.col("state") == "PUBLISHED") & (
        F.col("updated_at") < now - F.make_interval(mins=F.lit(publish_minutes))
    )
    return outbox.withColumn(
        "new_state", F.when(expired | stale, "TIMED_OUT").otherwise(F.col("state"))
    )


def work_queue(outbox: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The oldest eligible jobs after reconciliation."""
    eligible = F.col("new_state").isin("PENDING", "RETRY", "TIMED_OUT") & (
        F.col("next_eligible_at").isNull() | (F.col("next_eligible_at") <= now)
    )
    return reconcile(outbox, now).where(eligible).orderBy("created_at", "job_id").limit(limit)


def after_failure(jobs: DataFrame, maximum_attempts: int = 5) -> DataFrame:
    """Claimed jobs that failed: retried, or dead once their attempts are used up."""
    return jobs.where(F.col("state") == "CLAIMED").withColumn(
        "new_state",
        F.when(F.col("attempt_count") >= maximum_attempts, "DEAD").otherwise("RETRY"),
    )


def manual_replay(jobs: DataFrame) -> DataFrame:
    """Published or failed jobs, queued again with fresh attempts."""
    return (
        jobs.where(F.col("state").isin("PUBLISHED", "RETRY", "TIMED_OUT", "DEAD"))
        .withColumn("state", F.lit("PENDING"))
        .withColumn("attempt_count", F.lit(0))
        .withColumn("replay_count", F.col("replay_count") + 1)
    )
