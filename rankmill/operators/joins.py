"""Join shapes that carry semantics of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.session import broadcast_if_small, cut_lineage, fits

HOT_SHARE = 1_000


def skew_safe_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, salts: int = 64
) -> DataFrame:
    """Inner join where a few keys may hold most rows of `large`.

    A `small` side within the checked size is broadcast. Otherwise keys with more than
    1/HOT_SHARE of the rows (so at most HOT_SHARE keys) are salted by `spread` on the large side
    and replicated on the other; all remaining keys join unsalted.
    """
    keys = list(keys)
    if fits(small):
        return large.join(F.broadcast(small), keys)
    sizes = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total = sizes.agg(F.sum("__rows").alias("__total"))
    hot = F.broadcast(
        sizes.join(F.broadcast(total))
        .where(F.col("__rows") * HOT_SHARE > F.col("__total"))
        .select(*keys, F.lit(True).alias("__hot"))
    )
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0))
    left = large.join(hot, keys, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = small.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def changes_in_jobs(
    changes: DataFrame, jobs: DataFrame, width: int = 1024
) -> DataFrame:
    """Pairs (change, job) of one store with `earliest_change_id <= change_id <= latest_change_id`.

    Jobs are repeated once per id bucket they touch, so the range condition runs inside an equi
    join on (store, bucket); a hot store is spread over its buckets.
    """
    first = F.floor(F.col("earliest_change_id") / width)
    last = F.floor(F.col("latest_change_id") / width)
    spans = jobs.withColumn("__bucket", F.explode(F.sequence(first, last)))
    points = changes.withColumn("__bucket", F.floor(F.col("change_id") / width))
    return (
        points.join(spans, ["store_id", "__bucket"])
        .where(
            (F.col("change_id") >= F.col("earliest_change_id"))
            & (F.col("change_id") <= F.col("latest_change_id"))
        )
        .drop("__bucket")
    )


def unresolved_failures(attempts: DataFrame, keys: Sequence[str] = ("subscription_id", "uuid")) -> DataFrame:
    """Deliveries whose newest attempt failed (one aggregate instead of a self anti-join)."""
    last = F.max_by(F.struct("success", "log_id"), F.col("log_id"))
    return (
        attempts.groupBy(*keys)
        .agg(last.alias("__last"))
        .where(~F.col("__last.success"))
        .select(*keys, F.col("__last.log_id").alias("log_id"))
    )


def product_stores(
    product_websites: DataFrame, stores: DataFrame, included: Sequence[int] | None = None
) -> DataFrame:
    """(store_id, product_id): every included store of each website a product is assigned to."""
    open_stores = stores.where(F.col("store_id") != 0).select("store_id", "website_id")
    if included is not None:
        open_stores = open_stores.where(F.col("store_id").isin(list(included)))
    return (
        product_websites.join(broadcast_if_small(open_stores), "website_id")
        .select("store_id", "product_id")
        .distinct()
    )


def subtree_products(
    categories: DataFrame, category_products: DataFrame, roots: DataFrame
) -> DataFrame:
    """(root_id, product_id) for products anywhere below each root category.

    Every category lists its ancestors from its own path, which turns the prefix match into an
    equi join.
    """
    ancestors = categories.select(
        "category_id", F.explode(F.split("path", "/")).alias("__ancestor")
    ).select("category_id", F.col("__ancestor").cast("long").alias("root_id"))
    wanted = ancestors.join(broadcast_if_small(roots.select("root_id").distinct()), "root_id")
    return (
        category_products.join(broadcast_if_small(wanted), "category_id")
        .select("root_id", "product_id")
        .distinct()
    )


def option_products(values: DataFrame, options: DataFrame) -> DataFrame:
    """(option_id, product_id) where a single or comma-listed attribute value names the option."""
    listed = values.select(
        "product_id", F.explode(F.split("value", ",")).alias("__option")
    ).select("product_id", F.expr("try_cast(__option as bigint)").alias("option_id"))
    return (
        listed.join(broadcast_if_small(options.select("option_id").distinct()), "option_id")
        .select("option_id", "product_id")
        .distinct()
    )


def ancestors_closure(
    start: DataFrame, edges: DataFrame, child: str = "child", parent: str = "parent"
) -> DataFrame:
    """All nodes reachable upward from `start` (column `node`), the start nodes included.

    Where every node has one parent (trees, chains) paths double: in each round the steps are joined with themselves,
    so that round r takes steps of length 2^r from all that is reached, and rounds grow with the logarithm of the
    depth. Where nodes have several parents such steps could outgrow the edges; then the newly reached nodes take
    one edge a round. A round without a new node ends both, as every shortest path passes all lengths. Each round
    checkpoints its new nodes (and its steps) only.
    """
    steps = cut_lineage(edges.select(F.col(child).alias("node"), F.col(parent).alias("__next")).where("node <> __next").distinct())
    doubling = steps.groupBy("node").count().where("count > 1").isEmpty()
    parts = [cut_lineage(start.select("node").distinct())]
    while True:
        reached = parts[0]
        for part in parts[1:]:
            reached = reached.union(part)
        source = reached if doubling else parts[-1]
        found = cut_lineage(source.join(steps, "node").select(F.col("__next").alias("node")).distinct().join(reached, "node", "left_anti"))
        if found.isEmpty():
            return reached
        parts.append(found)
        if doubling:
            onward = steps.select(F.col("node").alias("__next"), F.col("__next").alias("__far"))
            steps = cut_lineage(steps.join(onward, "__next").select("node", F.col("__far").alias("__next")).where("node <> __next"))


def changed_keys(
    before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Keys added, removed or holding a different value, with both values."""
    old = before.select(*keys, F.struct(*columns).alias("__old"))
    new = after.select(*keys, F.struct(*columns).alias("__new"))
    joined = old.join(new, list(keys), "full_outer").where(
        ~F.col("__old").eqNullSafe(F.col("__new"))
    )
    kind = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .otherwise("changed")
    )
    return joined.select(
        *keys,
        kind.alias("change"),
        *[F.col(f"__old.{c}").alias(f"old_{c}") for c in columns],
        *[F.col(f"__new.{c}").alias(f"new_{c}") for c in columns],
    )
