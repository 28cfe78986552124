"""Ranking, positions, samples and percentiles without unpartitioned windows over data rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankmill.functions.ids import natural_order
from rankmill.session import cut_lineage

RESULT_DEPTH = 100


def top_k(
    scored: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first `k` rows of each key with their rank.

    The `rank <= k` filter directly on `row_number` becomes a group limit: every task first keeps
    its own `k` rows per key, so a hot key never moves as a whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def score_order(score: str = "score", document: str = "document_id") -> list[Column]:
    return [F.col(score).desc(), *natural_order(document)]


def to_run(scored: DataFrame, tag: str, k: int = RESULT_DEPTH) -> DataFrame:
    """Ranked run rows: score descending, then natural id order."""
    return top_k(scored, ["query_id"], score_order(), k).select(
        "query_id", "document_id", "rank", "score", F.lit(tag).alias("tag")
    )


def rank_score(run: DataFrame, depth: int = RESULT_DEPTH) -> DataFrame:
    """Replace scores by `depth - rank + 1`, which keeps the order exactly."""
    return run.withColumn("score", (F.lit(depth) - F.col("rank") + 1).cast("double"))


def retag(run: DataFrame, tag: str) -> DataFrame:
    return run.withColumn("tag", F.lit(tag))


def dense_index(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Gap-free zero-based positions in a total order.

    Range-sort, checkpoint (so both later reads see the same partitions even if executors are
    lost), then add each partition's offset. Only the per-partition counts meet in one task.
    """
    row = F.col("__row")
    cut = cut_lineage(df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright(row, 33)
    counts = cut.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    return (
        cut.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(name, F.col("__offset") + row.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__row", "__offset")
    )


def spanning_sample(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """`size` rows at evenly spaced positions of the order, first and last row included."""
    indexed = dense_index(df, order)
    total = indexed.agg(F.count(F.lit(1)).alias("__total"))
    wanted = (
        total.where(F.col("__total") > 0)
        .select("__total", F.least(F.col("__total"), F.lit(size)).alias("__size"))
        .select(
            "__total", "__size", F.explode(F.sequence(F.lit(0), F.col("__size") - 1)).alias("__i")
        )
        .select(
            F.when(F.col("__size") == 1, F.lit(0))
            .otherwise(F.expr("(__i * (__total - 1)) div (__size - 1)"))
            .cast("long").alias("position")
        )
    )
    return indexed.join(F.broadcast(wanted), "position")  # exactly `size` rows


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    rule: str = "linear",
    bins: int = 256,
    weight: str | None = None,
) -> DataFrame:
    """Exact percentiles per key for keys of any size.

    Equal values are counted before any shuffle by key; a histogram per key locates the bins that
    hold the wanted ranks, and only the values in those bins are ordered. A bin is met again by its
    lowest and highest value, not by its number: the quartiles behind the numbers are approximate and
    depend on the order in which shuffled parts arrive. Bins are even around the
    median, in units of the quartile distance, and grow with the distance from it, so outliers on
    either side cannot push the other values into one bin. `bins` is their number per unit of the scale.
    `rule` is `linear` (interpolate between neighbours) or `nearest` (value at ceil(n*p)).
    `weight` names a count column of pre-aggregated rows.
    """
    keys = list(keys)
    v, n = F.col("__v"), F.col("__n")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    )
    anchor = keys or ["__all"]
    if not keys:
        counts = counts.withColumn("__all", F.lit(1))
    bounds = counts.groupBy(*anchor).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__total"),
        F.percentile_approx("__v", [0.25, 0.5, 0.75], 1000).alias("__quarters"),
    )
    low, middle, high = (F.get("__quarters", F.lit(i)) for i in range(3))
    unit = F.when(high > low, (high - low) / 64).otherwise((F.col("__hi") - F.col("__lo")) / 1024)
    away = v - middle
    binned = counts.join(bounds, anchor).withColumn(
        "__bin",
        F.when(unit > 0, F.floor(F.signum(away) * F.log1p(F.abs(away) / unit) * bins)).otherwise(0).cast("int"),
    ).drop("__quarters")
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, p in points.items():
        if rule == "nearest":
            low = F.greatest(F.lit(0), F.ceil(F.col("__total") * F.lit(p)) - 1)
            ranks[name] = (low, low, F.lit(0.0))
        else:
            spot = (F.col("__total") - 1) * F.lit(p)
            ranks[name] = (F.floor(spot), F.ceil(spot), spot - F.floor(spot))
    spots = [r for low, high, _ in ranks.values() for r in (low, high)]

    def holds(start: Column, count: Column) -> Column:
        test = F.lit(False)
        for r in spots:
            test = test | ((r >= start) & (r < start + count))
        return test

    histogram = binned.groupBy(*anchor, "__bin", "__total").agg(
        F.sum("__n").alias("__count"), F.min("__v").alias("__first"), F.max("__v").alias("__last")
    )
    by_bin = W.partitionBy(*anchor).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    wanted = histogram.withColumn(
        "__before", F.coalesce(F.sum("__count").over(by_bin), F.lit(0))
    ).where(holds(F.col("__before"), F.col("__count")))
    in_bin = W.partitionBy(*anchor, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    spans = wanted.select(*anchor, "__bin", "__total", "__before", "__first", "__last")
    placed = counts.join(spans, anchor).where(v.between(F.col("__first"), F.col("__last")))
    placed = placed.withColumn(
        "__start", F.col("__before") + F.coalesce(F.sum("__n").over(in_bin), F.lit(0))
    ).where(holds(F.col("__start"), n))

    def at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("__start")) & (r < F.col("__start") + n), v))

    columns = []
    for name, (low, high, share) in ranks.items():
        below = at(low)
        columns.append((below + (at(high) - below) * F.max(share)).alias(name))
    return placed.groupBy(*anchor).agg(*columns).drop("__all")
