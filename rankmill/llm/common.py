"""Helpers the operators of this package share: table access and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

#: Most rows of text that one Arrow batch holds; long texts make Python batches heavy.
BATCH_TEXTS = 256
#: White space that ends a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches of a session whose rows are whole texts, and so the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pd.DataFrame], rows: int = BATCH_TEXTS) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to at most ``rows`` rows, so that a batch of long texts stays small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def hash_share(key: Column) -> Column:
    """A stable value in [0, 1) by the hash of ``key``; below p for about a share p of the keys."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)).cast("double") / float(1 << 31)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node id reachable.

    Each round hooks every node to its smallest neighbour, follows the parents to their roots by
    pointer jumping (two jumps a job), and contracts the edges to the roots, so the edge table shrinks from round to
    round. All state is a table under the checkpoint folder: nothing is collected and no group is
    gathered in a task. Null ends and self links are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        while True:  # the first jump reads the parents by node as the aggregate partitions them
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
            twice = parents.join(up, "root").select("node", F.col("up").alias("root")).join(up, "root")
            parents = cut_lineage(twice.select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            if parents.where("moved").isEmpty():
                break
            parents = parents.select("node", "root")
        parents = parents.select("node", "root")
        if roots is None:
            roots = parents
        else:
            later = parents.select(F.col("node").alias("root"), F.col("root").alias("later"))
            roots = cut_lineage(roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")))
        to_a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        pairs = cut_lineage(
            pairs.join(to_a, "a").join(to_b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        if pairs.isEmpty():
            return roots
