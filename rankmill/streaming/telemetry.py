"""Windowed telemetry counts over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.operators.ordering import exact_percentiles
from rankmill.sources.telemetry_log import telemetry_records

BY = ("window_start", "store_id", "request_name", "route", "reason")


def stream_telemetry(
    records: DataFrame, window_seconds: int = 300, slide_seconds: int | None = None,
    watermark_seconds: int | None = None,
) -> DataFrame:
    """Append stream of closed windows: (window_start, store_id, request, route, reason, duration_ms, requests).

    Counting per distinct duration spreads a busy store's state over many keys and keeps every
    later percentile exact (`window_routes`, `window_latency`). The watermark equals the window
    unless given; rows behind it are dropped.
    """
    delay = watermark_seconds if watermark_seconds is not None else window_seconds
    window = F.window(
        "ts", f"{window_seconds} seconds", f"{slide_seconds or window_seconds} seconds"
    )
    return (
        records.withWatermark("ts", f"{delay} seconds")
        .groupBy(window.alias("w"), "store_id", "request_name", "route", "reason", "duration_ms")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            F.unix_seconds("w.start").alias("window_start"), "store_id", "request_name", "route",
            "reason", "duration_ms", "requests",
        )
    )


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 1, **options: str) -> DataFrame:
    """Telemetry records as a stream of the log files that arrive under `path`; rejected lines are left out.

    `options` go to the reader; the marker of a record is `sources.telemetry_log.MARKER`.
    """
    lines = spark.readStream.options(**options).option("maxFilesPerTrigger", files_per_batch).text(path)
    return telemetry_records(lines)


def late_rows(records: DataFrame, closed: DataFrame, window_seconds: int = 300, slide_seconds: int | None = None) -> DataFrame:
    """(window_start, store_id, recorded, streamed, late) of the closed windows that lost rows to the watermark.

    `records` are the records of the log read as a table, `closed` what `stream_telemetry` has written. Both are counted
    per window and store before they meet.
    """
    window = F.window("ts", f"{window_seconds} seconds", f"{slide_seconds or window_seconds} seconds")
    by = ["window_start", "store_id"]
    recorded = records.select(F.unix_seconds(window.start).alias("window_start"), "store_id").groupBy(*by).agg(F.count(F.lit(1)).alias("recorded"))
    streamed = closed.groupBy(*by).agg(F.sum("requests").alias("streamed"))
    last = closed.agg(F.max("window_start").alias("last"))  # windows close in order
    return (
        recorded.join(F.broadcast(last), F.col("window_start") <= F.col("last")).drop("last")
        .join(streamed, by, "left").fillna(0, ["streamed"])
        .withColumn("late", F.col("recorded") - F.col("streamed")).where("late > 0")
    )


def window_routes(closed: DataFrame) -> DataFrame:
    """Route counts per window from the closed-window counts."""
    return closed.groupBy(*BY).agg(F.sum("requests").alias("requests"))


def window_fallback(closed: DataFrame) -> DataFrame:
    fallbacks = F.sum(F.when(F.col("route") == "native_fallback", F.col("requests")).otherwise(0))
    return closed.groupBy("window_start", "store_id", "request_name").agg(
        F.sum("requests").alias("requests"), (fallbacks / F.sum("requests")).alias("fallback_ratio")
    )


def window_latency(closed: DataFrame) -> DataFrame:
    """Observations and nearest-rank p95 per (window, store, request, route)."""
    by = ["window_start", "store_id", "request_name", "route"]
    counts = closed.groupBy(*by).agg(F.sum("requests").alias("observations"))
    points = exact_percentiles(
        closed, by, "duration_ms", {"p95_duration_ms": 0.95}, "nearest", weight="requests"
    )
    return counts.join(points, by)
