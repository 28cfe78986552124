"""Structured Streaming queries, run to completion over the event table."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from rankmill.plans.change_queries import LATEST_SQL, _OFFERS
from rankmill.plans.monitoring_queries import FAILURES
from rankmill.plans.lexical_queries import with_more
from rankmill.plans.registry import query
from rankmill.plans.source_queries import _CAST_V, log_lines
from rankmill.sources import telemetry_log as tl
from rankmill.streaming import apply as ap
from rankmill.streaming import failures as fl
from rankmill.streaming import latest as lt
from rankmill.streaming import telemetry as st

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(spark, start):
    """Start a stream with the RocksDB state store.

    A query keeps the settings it was started with. On a local session it gets one state partition
    per core; a cluster's own setting is left alone.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if spark.sparkContext.master.startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def event_stream(t, parts: int = 1):
    """The event table as a file stream; more than one part arrives in several micro-batches."""
    if parts > 1:
        path = t.scratch("events")
        t.events.repartition(parts).write.parquet(path)
        return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(started, seconds: float = 600.0):
    """Wait for an availableNow query."""
    deadline = time.time() + seconds
    while started.isActive and time.time() < deadline:
        started.awaitTermination(5)
    if started.isActive:
        started.stop()
        raise TimeoutError("the stream did not finish")
    if started.exception():
        raise started.exception()


def _sink(t, rows, name: str, mode: str):
    """Write a stream to a fresh Parquet table and return it (update output is appended)."""
    out, checkpoint = t.scratch(name), t.scratch(f"{name}-checkpoint")
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "update":
        writer = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    else:
        writer = writer.format("parquet").option("path", out)
    _finish(_start(t.spark, writer.start))
    return t.spark.read.parquet(out)


@query("st1_stream_latest", "store_id:i product_id:i revision:i sequence:i operation:s", LATEST_SQL)
def _(t):
    changes = event_stream(t, 4).selectExpr(
        "user_id % 3 + 1 store_id", "user_id product_id", "(event_id * 48271) % 65537 revision", "event_id sequence",
        "case when event_type in ('purchase', 'signup') then 'UPSERT' when event_type = 'error' then 'DELETE' else 'REFRESH' end operation",
    )
    updates = _sink(t, lt.stream_latest(changes), "latest", "update")
    newest = F.max_by(F.struct("revision", "sequence", "operation"), F.struct("revision", "sequence"))
    return updates.groupBy("store_id", "product_id").agg(newest.alias("r")).select("store_id", "product_id", "r.*")


_STREAMED = (
    f"SELECT * FROM ({_OFFERS}) QUALIFY row_number() OVER (PARTITION BY store_id, product_id, generation_id ORDER BY revision DESC, status = 'DELETED' DESC) = 1"
)


@query("st2_stream_apply", "store_id:i product_id:i generation_id:i revision:i status:s", _STREAMED)
def _(t):
    path, checkpoint = t.scratch("store"), t.scratch("store-checkpoint")
    rows = event_stream(t, 3).selectExpr(
        "user_id % 3 + 1 store_id", "user_id product_id", "user_id % 2 + 1 generation_id", "event_id div 200 revision",
        "event_id sequence", "if(event_type = 'error', 'DELETED', 'COMPLETE') status", "sha2(event_type, 256) source_hash",
        "cast(event_type as binary) vector",
    )
    _finish(_start(t.spark, lambda: ap.stream_apply(rows, path, checkpoint)))
    return ap.read_store(t.spark, path)


_CLOSED = (
    "SELECT epoch_us(ts) // 3600000000 * 3600 AS window_start, user_id % 3 + 1 AS store_id, CASE WHEN event_id % 2 = 0 THEN 'quick_search_container' ELSE 'graphql_product_search' END AS request_name, "
    "CASE WHEN event_type = 'error' THEN 'native_fallback' WHEN event_type IN ('click', 'view') THEN 'hybrid' ELSE 'native' END AS route, "
    "CASE WHEN event_type = 'error' THEN 'hybrid_error' WHEN event_type IN ('click', 'view') THEN 'eligible' ELSE 'known_item' END AS reason, value FROM events "
    "WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)"
)


def closed_windows(t):
    records = event_stream(t).selectExpr(
        "ts", "user_id % 3 + 1 store_id", "if(event_id % 2 = 0, 'quick_search_container', 'graphql_product_search') request_name",
        "case when event_type = 'error' then 'native_fallback' when event_type in ('click', 'view') then 'hybrid' else 'native' end route",
        "case when event_type = 'error' then 'hybrid_error' when event_type in ('click', 'view') then 'eligible' else 'known_item' end reason",
        "value duration_ms",
    )
    return _sink(t, st.stream_telemetry(records, 3600), "telemetry", "append")


@query("st3_stream_route_counts", "window_start:i store_id:i request_name:s route:s reason:s requests:i",
       f"SELECT window_start, store_id, request_name, route, reason, count(*) AS requests FROM ({_CLOSED}) GROUP BY ALL")
def _(t):
    return st.window_routes(closed_windows(t))


@query("st3_stream_fallback", "window_start:i store_id:i request_name:s requests:i fallback_ratio:f6",
       f"SELECT window_start, store_id, request_name, count(*) AS requests, count(*) FILTER (route = 'native_fallback') / count(*) AS fallback_ratio FROM ({_CLOSED}) GROUP BY 1, 2, 3")
def _(t):
    return st.window_fallback(closed_windows(t))


@query("st3_stream_latency", "window_start:i store_id:i request_name:s route:s observations:i p95_duration_ms:f6",
       f"SELECT window_start, store_id, request_name, route, count(*) AS observations, quantile_disc(value, 0.95) AS p95_duration_ms FROM ({_CLOSED}) GROUP BY 1, 2, 3, 4")
def _(t):
    return st.window_latency(closed_windows(t))


_CHUNKS = 5
_HOUR, _SLIDE = 3_600, 1_800
# A chunk is a fifth of the time; some rows of the first come with the last.
_CHUNK = f"CASE WHEN (epoch_us(ts) - lo) * {_CHUNKS} // (hi - lo + 1) = 0 AND {_CAST_V} % 10 = 7 THEN {_CHUNKS - 1} ELSE (epoch_us(ts) - lo) * {_CHUNKS} // (hi - lo + 1) END"
# Rows are late if their window had ended before the batch before theirs began to close windows.
_LOGGED = (
    f"numbered AS (SELECT * FROM telemetry, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)), placed AS (SELECT *, {_CHUNK} AS chunk FROM numbered WHERE {_CAST_V} NOT IN (1, 2, 3, 4, 5)), "
    f"marks AS (SELECT c.chunk, (SELECT max(epoch_ms(ts)) FROM placed p WHERE p.chunk <= c.chunk - 2) - {_HOUR * 1000} AS mark FROM (SELECT DISTINCT chunk FROM placed) c), "
    f"spread AS (SELECT p.*, (epoch_us(ts) // {_SLIDE * 1_000_000} - s) * {_SLIDE} AS window_start FROM placed p, (SELECT unnest(range({_HOUR // _SLIDE})) AS s)), "
    f"shut AS (SELECT s.*, m.mark IS NULL OR (window_start + {_HOUR}) * 1000 > m.mark AS in_time FROM spread s JOIN marks m USING (chunk) WHERE (window_start + {_HOUR}) * 1000 <= (SELECT max(epoch_ms(ts)) - {_HOUR * 1000} FROM placed))"
)


_FILE_ROWS = 10_000


def write_log(t, path):
    """Write the log in chunks of as many files each, which is returned; a chunk is written by as many tasks.

    Each file has _FILE_ROWS rows or more, unless a chunk has one file only.
    """
    e, at = t.telemetry, F.unix_micros("ts")
    low, high = e.agg(F.min(at), F.max(at)).head()
    chunk = F.expr(f"(unix_micros(ts) - {low}) * {_CHUNKS} div {high - low + 1}")
    chunk = F.when((chunk == 0) & ((F.col("duration_ms") * 100).cast("int") % 10 == 7), _CHUNKS - 1).otherwise(chunk)
    sizes = {r.chunk: r["count"] for r in e.groupBy(chunk.alias("chunk")).count().collect()}  # one row per chunk
    least = min(sizes.get(i, 0) for i in range(_CHUNKS))
    files = max(1, min(t.spark.sparkContext.defaultParallelism, least // _FILE_ROWS))
    for i in range(_CHUNKS):
        log_lines(t, e.where(chunk == i).repartition(files)).write.mode("append").text(path)
        time.sleep(0.05)  # files are taken in the order of their times
    return files


def logged_windows(t):
    """(log folder, closed sliding windows) of a log that arrives in five chunks, some rows long after their time."""
    path = t.scratch("log")
    records = st.stream_log(t.spark, path, files_per_batch=write_log(t, path))
    return path, _sink(t, st.stream_telemetry(records, _HOUR, _SLIDE), "sliding", "append")


@query("st3_stream_log_windows", "window_start:i store_id:i request_name:s route:s observations:i p95_duration_ms:f6",
       with_more("telemetry", _LOGGED, "SELECT window_start, store_id, request_name, route, count(*) AS observations, quantile_disc(duration_ms, 0.95) AS p95_duration_ms FROM shut WHERE in_time GROUP BY 1, 2, 3, 4"))
def _(t):
    return st.window_latency(logged_windows(t)[1])


@query("st3_stream_log_late_rows", "window_start:i store_id:i recorded:i streamed:i late:i",
       with_more("telemetry", _LOGGED, "SELECT * FROM (SELECT window_start, store_id, count(*) AS recorded, count(*) FILTER (in_time) AS streamed, count(*) FILTER (NOT in_time) AS late FROM shut GROUP BY 1, 2) WHERE late > 0"))
def _(t):
    path, closed = logged_windows(t)
    return st.late_rows(tl.telemetry_records(t.spark.read.text(path)), closed, _HOUR, _SLIDE)


@query("st4_stream_failure_runs", "store_id:i sequence:i failures:i", FAILURES.format(memory=1_800_000_000))
def _(t):
    outcomes = event_stream(t).selectExpr(
        "user_id % 3 + 1 store_id", "ts", "event_id sequence", "event_type not in ('error', 'view', 'click') success"
    )
    return _sink(t, fl.stream_failure_runs(outcomes, memory_seconds=1800), "failures", "update")


