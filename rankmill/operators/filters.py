"""Predicates over products, documents and search requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.text import canonicalize, squeeze
from rankmill.session import broadcast_if_small

# Enabled status, search-visible settings and supported request names.
ENABLED = 1
SEARCH_VISIBLE = (3, 4)
REQUEST_NAMES = ("quick_search_container", "graphql_product_search")


def is_searchable() -> Column:
    return (F.col("status") == ENABLED) & F.col("visibility").isin(*SEARCH_VISIBLE)


def searchable(products: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Enabled, search-visible products; with `assignments` (store_id, product_id) per store."""
    kept = products.where(is_searchable())
    if assignments is None:
        return kept
    return assignments.select("store_id", "product_id").distinct().join(kept, "product_id")


def similarity_eligible(
    documents: DataFrame, store_id: int, generation_id: int, model_revision: str
) -> DataFrame:
    """Documents a similarity search may return; all predicates are simple and reach the scan."""
    return documents.where(
        (F.col("store_id") == store_id)
        & (F.col("generation_id") == generation_id)
        & (F.col("model_revision") == model_revision)
        & F.col("embedding_eligible")
        & is_searchable()
        & F.col("is_salable")
    )


def catalog_filter(documents: DataFrame, field: str, value: str) -> DataFrame:
    return documents.where(F.col(field) == value)


# -- requests ------------------------------------------------------------------------------------

def _upper(sort: Column) -> Column:
    return F.transform(
        F.coalesce(sort, F.array().cast("array<struct<field:string,direction:string>>")),
        lambda e: F.struct(
            e["field"].alias("field"), F.upper(e["direction"]).alias("direction")
        ),
    )


def _is(entry: Column, field: str | Sequence[str], direction: str | None = None) -> Column:
    names = [field] if isinstance(field, str) else list(field)
    test = F.coalesce(entry["field"].isin(*names), F.lit(False))
    if direction:
        test = test & F.coalesce(entry["direction"] == direction, F.lit(False))
    return test


def _tie_breaker(entry: Column) -> Column:
    return _is(entry, "entity_id") & F.coalesce(
        entry["direction"].isin("ASC", "DESC"), F.lit(False)
    )


def _relevance(entries: Column) -> Column:
    """Score descending, optionally followed by the entity id."""
    lead = _is(F.get(entries, F.lit(0)), ("_score", "score", "relevance"), "DESC")
    return lead & (
        (F.size(entries) == 1) | ((F.size(entries) == 2) & _tie_breaker(F.get(entries, F.lit(1))))
    )


def _default_position(entries: Column) -> Column:
    lead = _is(F.get(entries, F.lit(0)), "position", "ASC")
    return lead & (
        (F.size(entries) == 1) | ((F.size(entries) == 2) & _tie_breaker(F.get(entries, F.lit(1))))
    )


def sort_plan(sort: Column) -> Column:
    """Class of a sort list `array<struct<field,direction>>`.

    relevance, default_position, availability_first (an out-of-stock flag before either of the
    former) or unsupported; an absent list is relevance.
    """
    entries = _upper(sort)
    rest = F.slice(entries, 2, F.greatest(F.lit(0), F.size(entries) - 1))
    available = _is(F.get(entries, F.lit(0)), "is_out_of_stock", "ASC")
    broken = F.exists(entries, lambda e: e["field"].isNull() | e["direction"].isNull())
    return (
        F.when(F.size(entries) == 0, "relevance")
        .when(broken, "unsupported")
        .when(_relevance(entries), "relevance")
        .when(_default_position(entries), "default_position")
        .when(
            (F.size(entries) >= 2) & available & (_relevance(rest) | _default_position(rest)),
            "availability_first",
        )
        .otherwise("unsupported")
    )


def request_reason() -> Column:
    """First rule that keeps a request on the native route, or null.

    Columns: enabled, store_included, ready, request_name, sort, start, size.
    """
    start = F.greatest(F.lit(0), F.coalesce("start", F.lit(0)))
    size = F.greatest(F.lit(0), F.coalesce("size", F.lit(0)))
    return (
        F.when(~F.col("enabled"), "disabled")
        .when(~F.col("store_included"), "store_excluded")
        .when(~F.col("ready"), "readiness_closed")
        .when(
            ~F.coalesce(F.col("request_name").isin(*REQUEST_NAMES), F.lit(False)),
            "unsupported_request",
        )
        .when(sort_plan(F.col("sort")) == "unsupported", "unsupported_sort")
        .when((size == 0) | (size > 100) | (start >= 100), "invalid_page")
    )


def known_item_route(query: Column, top_title: Column, sku_prefix: str) -> Column:
    """sku text, exact title of the best lexical hit, or hybrid."""
    text = squeeze(query)
    return (
        F.when(F.startswith(text, F.lit(f"{sku_prefix.lower()}-")), "lexical_only_sku")
        .when((text != "") & text.eqNullSafe(squeeze(top_title)), "lexical_only_exact_title")
        .otherwise("hybrid")
    )


def known_item_guard(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, known_item): blank, or equal to some normalised SKU or title.

    `documents` has sku_normalized and title_normalized. Only the distinct query texts travel to
    the documents.
    """
    keyed = queries.select("query_id", canonicalize(F.col("query")).alias("__text"))
    texts = broadcast_if_small(keyed.select("__text").distinct())
    names = documents.select(
        F.explode(F.array("sku_normalized", "title_normalized")).alias("__text")
    )
    known = names.join(texts, "__text", "left_semi").distinct().withColumn("__hit", F.lit(True))
    return keyed.join(known, "__text", "left").select(
        "query_id",
        ((F.col("__text") == "") | F.coalesce("__hit", F.lit(False))).alias("known_item"),
    )
