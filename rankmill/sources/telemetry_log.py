"""Query telemetry log lines, from batch or streaming text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.filters import REQUEST_NAMES
from rankmill.schemas import TELEMETRY_JSON

# Names a telemetry record may use.
ROUTES = ("native", "hybrid", "native_fallback")
REASONS = (
    "ineligible", "disabled", "store_excluded", "readiness_closed", "unsupported_request",
    "invalid_page", "unsupported_sort", "circuit_open", "known_item", "no_candidates", "eligible",
    "hybrid_error",
)
COMPONENTS = ("native_candidates", "query_encoder", "other")
FUSED_COMPONENT = "hybrid_search"
OUTCOMES = ("success", "failure")
MARKER = "query telemetry."
MAXIMUM_MS = 60_000.0


def _duration(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when((value >= 0) & (value <= MAXIMUM_MS), value)


def parse_telemetry(
    lines: DataFrame, marker: str = MARKER, fused_component: str = FUSED_COMPONENT
) -> DataFrame:
    """One row per marked line with `accepted`; fields are null on rejected lines.

    Components with unknown names, outcomes or durations are dropped from their record.
    `marker` is the text before a record and `fused_component` the name under which a log reports
    its fused search; both depend on the installation.
    """
    pattern = r"^\[([^\]]+)\].*" + marker.replace(".", r"\.") + r" (\{.*\}) \[\]\s*$"
    record = (
        lines.where(F.col("value").contains(marker))
        .select(
            F.regexp_extract("value", pattern, 1).alias("__ts"),
            F.from_json(F.regexp_extract("value", pattern, 2), TELEMETRY_JSON).alias("r"),
        )
        .select(F.try_to_timestamp("__ts").alias("ts"), "r.*")
    )
    store = F.col("store_id").try_cast("long")
    duration = _duration(F.col("duration_ms"))
    accepted = F.coalesce(
        F.col("ts").isNotNull()
        & (F.col("schema_version") == 1)
        & (F.col("event") == "query_route")
        & (store >= 1)
        & F.col("request_name").isin(*REQUEST_NAMES)
        & F.col("route").isin(*ROUTES)
        & F.col("reason").isin(*REASONS)
        & duration.isNotNull(),
        F.lit(False),
    )
    typed = F.transform_values(
        F.coalesce("components", F.create_map().cast("map<string,struct<outcome:string,duration_ms:string>>")),
        lambda _, m: F.struct(
            m["outcome"].alias("outcome"), _duration(m["duration_ms"]).alias("duration_ms")
        ),
    )
    known = F.map_filter(
        typed,
        lambda name, m: name.isin(*COMPONENTS, fused_component)
        & F.coalesce(m["outcome"].isin(*OUTCOMES), F.lit(False))
        & m["duration_ms"].isNotNull(),
    )

    def kept(value: Column) -> Column:
        return F.when(accepted, value)

    return record.select(
        accepted.alias("accepted"),
        kept(F.col("ts")).alias("ts"), kept(store).alias("store_id"),
        kept(F.col("request_name")).alias("request_name"), kept(F.col("route")).alias("route"),
        kept(F.col("reason")).alias("reason"), kept(duration).alias("duration_ms"),
        kept(known).alias("components"),
    )


def telemetry_records(
    lines: DataFrame, marker: str = MARKER, fused_component: str = FUSED_COMPONENT
) -> DataFrame:
    """Accepted records only."""
    return parse_telemetry(lines, marker, fused_component).where(F.col("accepted")).drop("accepted")
