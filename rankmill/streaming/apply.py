"""Applying a change stream to the embedding store, batch by batch.

The store is cut by generation and product bucket. A micro-batch writes the buckets that it touches into a folder
of its own, `version=<batch id>/generation_id=<g>/bucket=<b>`, with one commit marker at the end; the files of all
other buckets stay as they are. The newest committed version of a bucket is the one that counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankmill.operators.changes import EMBEDDING_KEY, apply_embeddings

STORE = (
    "store_id long, product_id long, generation_id long, revision long, status string, "
    "source_hash string, vector binary"
)
_COLUMNS = [*EMBEDDING_KEY, "revision", "status", "source_hash", "vector"]
#: Product buckets of a generation. A store keeps the number it was begun with.
BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("store_id", "product_id"), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, path: str, before: int | None = None) -> dict[tuple[str, str], list[tuple[int, str]]]:
    """(generation, bucket) to its committed (version, folder), newest first. Reads folder listings only.

    Versions from `before` on are left out. There are at most as many folders as buckets and versions that
    `remove_superseded` has not cleared.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for marker in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS")) or []:
        folder = marker.getPath().getParent()
        version = int(folder.getName().split("=")[1])
        if before is not None and version >= before:
            continue
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "generation_id=*/bucket=*")) or []:
            place = status.getPath().toString()
            key = re.search(r"generation_id=([^/]*)/bucket=([^/]*)$", place)
            found.setdefault((key[1], key[2]), []).append((version, place))
    return {key: sorted(versions, reverse=True) for key, versions in found.items()}


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).option("basePath", path).parquet(*sorted(folders)).select(*_COLUMNS)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of every bucket; empty before the first batch."""
    return _read(spark, path, [versions[0][1] for versions in _folders(spark, path).values()])


def apply_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> None:
    """Write the buckets that the batch touches, from their newest versions before it.

    A replayed batch rewrites the same folder from the same predecessors, so replays change nothing; within a
    batch the revision decides. A batch without rows writes nothing.
    """
    spark = batch.sparkSession
    touched = batch.select(F.col("generation_id").cast("string").alias("g"), _bucket(buckets).cast("string").alias("b")).distinct().collect()  # one row per bucket
    if not touched:
        return
    earlier = _folders(spark, path, batch_id)
    store = _read(spark, path, [earlier[r.g, r.b][0][1] for r in touched if (r.g, r.b) in earlier])
    applied = apply_embeddings(store, batch).select(*_COLUMNS).withColumn("bucket", _bucket(buckets))
    # one file per bucket, whatever the number of tasks
    applied.repartition("generation_id", "bucket").write.mode("overwrite").partitionBy("generation_id", "bucket").parquet(f"{path}/version={batch_id}")


def remove_superseded(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest `keep` versions of each bucket; the number of folders deleted.

    Keep two at least while a stream runs: the last batch may be replayed.
    """
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [folder for versions in _folders(spark, path).values() for _, folder in versions[keep:]]
    for folder in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
    return len(old)


def stream_apply(changes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start applying (key, revision, status, source_hash, vector, sequence) rows to the store."""
    return (
        changes.writeStream.foreachBatch(lambda batch, i: apply_batch(batch, i, path, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
