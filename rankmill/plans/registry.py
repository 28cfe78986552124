"""Named queries with their output columns and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    """`name:type` words; types are s (text), i (64-bit), b (boolean), f<digits> (rounded double)."""
    return [tuple(word.rsplit(":", 1)) for word in spec.split()]


def _spark(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    if kind == "s":
        column = column.cast("string")
    elif kind == "i":
        column = column.cast("long")
    elif kind == "b":
        column = column.cast("boolean")
    else:
        column = F.round(column.cast("double"), int(kind[1:])) + F.lit(0.0)
    return column.alias(name)


def _sql(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind == "s":
        value = f"CAST({quoted} AS VARCHAR)"
    elif kind == "i":
        value = f"CAST({quoted} AS BIGINT)"
    elif kind == "b":
        value = f"CAST({quoted} AS BOOLEAN)"
    else:
        value = f"round(CAST({quoted} AS DOUBLE), {kind[1:]}) + 0.0"
    return f"{value} AS {quoted}"


def query(name: str, spec: str, sql: str | None = None):
    """Register a query; both sides are projected to the same names and types."""
    columns = _columns(spec)

    def register(build: Callable) -> Callable:
        from rankmill.plans.tables import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir)).select(*[_spark(n, k) for n, k in columns])

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql(n, k) for n, k in columns)} FROM ({sql})"
        return build

    return register
