"""Searchable product documents from catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.schemas import PRICE_ROW
from rankmill.session import broadcast_if_small


def _natural_text_key(text: Column) -> Column:
    """Case-insensitive natural order: digit runs compare as numbers of the same width."""
    padded = F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)),
        lambda part: F.when(
            part.rlike("^[0-9]"), F.lpad(F.regexp_replace(part, "^0+", ""), 20, "0")
        ).otherwise(part),
    )
    return F.array_join(padded, "")


def category_text(
    product_categories: DataFrame, categories: DataFrame, root_id: int = 1
) -> DataFrame:
    """(product_id, category): the paths of a product's categories as names.

    `categories` is (category_id, path, name) with `/`-separated id paths. Ids up to `root_id` are
    structural. Names are resolved per category, not per product; a product's distinct paths are
    in natural order and joined by ` | `.
    """
    steps = categories.select(
        "category_id", F.posexplode(F.split("path", "/")).alias("pos", "__step")
    ).select("category_id", "pos", F.col("__step").cast("long").alias("__id"))
    names = categories.select(
        F.col("category_id").alias("__id"), F.trim("name").alias("__name")
    ).where((F.col("__name") != "") & (F.col("__id") > root_id))
    paths = (
        steps.join(names, "__id")
        .groupBy("category_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "__name"))).alias("__parts"))
        .select("category_id", F.array_join(F.col("__parts.__name"), " / ").alias("__path"))
    )
    resolved = (
        product_categories.select("product_id", "category_id")
        .join(broadcast_if_small(paths), "category_id")
        .select("product_id", "__path")
        .distinct()
        .groupBy("product_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(_natural_text_key(F.col("__path")).alias("k"), "__path"))
            ).alias("__paths")
        )
    )
    return resolved.select(
        "product_id", F.array_join(F.col("__paths.__path"), " | ").alias("category")
    )


def brand_and_features(brands: Sequence[Column], features: Sequence[Column]) -> tuple[Column, Column]:
    """First non-empty brand attribute; distinct non-empty features in registry order."""
    brand = F.coalesce(*[F.nullif(F.trim(b), F.lit("")) for b in brands], F.lit(""))
    kept = F.filter(
        F.transform(F.array(*features), lambda v: F.trim(F.coalesce(v, F.lit("")))),
        lambda v: v != "",
    )
    return brand, F.array_join(F.array_distinct(kept), " | ")


def group_prices(prices: DataFrame) -> DataFrame:
    """(product_id, customer_group_prices): one product's price rows ordered by group and website."""
    fields = [f.split(":")[0] for f in PRICE_ROW[len("struct<"):-1].split(",")]
    row = F.struct(*[F.col(f) for f in fields]).cast(PRICE_ROW)
    return prices.groupBy("product_id").agg(
        F.array_sort(F.collect_list(row)).alias("customer_group_prices")
    )


def document_snapshot(
    documents: DataFrame, vectors: DataFrame, generation_id: int, model_revision: str
) -> DataFrame:
    """The searchable row per product; `embedding_eligible` says whether it has a vector."""
    return (
        documents.join(vectors.select("entity_id", "embedding"), "entity_id", "left")
        .withColumn("generation_id", F.lit(generation_id).cast("long"))
        .withColumn("model_revision", F.lit(model_revision))
        .withColumn("embedding_eligible", F.col("embedding").isNotNull())
    )
