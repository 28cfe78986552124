"""Explicit schemas of every table; no reader infers types."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def schema(text: str = "", number: str = "", integer: str = "") -> StructType:
    """A flat schema from comma-separated column names per type."""
    fields = []
    for names, kind in ((text, StringType()), (number, DoubleType()), (integer, IntegerType())):
        fields += [StructField(n.strip(), kind) for n in names.split(",") if n.strip()]
    return StructType(fields)


PRODUCT_TSV = schema(
    "product_id, product_name, product_class, category hierarchy, product_description, "
    "product_features, rating_count, average_rating, review_count"
)
QUERY_TSV = schema("query_id, query, query_class")
LABEL_TSV = schema("id, query_id, product_id, label")
TOPIC_TSV = schema("id, query")
TREC_JSON = schema("docid, title, text")
PRODUCT_JSON = schema(
    "product_id, title, description, category, product_class, brand, features",
    number="rating_count, average_rating, review_count",
)
QUERY_JSON = schema("query_id, query, query_class, split", integer="token_count")
SPARSE_JSON = "product_id string, embedding map<string,string>"
TELEMETRY_JSON = (
    "schema_version int, event string, store_id string, request_name string, route string, "
    "reason string, duration_ms string, "
    "components map<string,struct<outcome:string,duration_ms:string>>"
)
PRICE_ROW = (
    "struct<customer_group_id:int,website_id:int,tax_class_id:int,regular_price:double,"
    "final_price:double,min_price:double,max_price:double,tier_price:double>"
)
