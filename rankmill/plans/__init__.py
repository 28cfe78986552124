"""Registered queries; importing this package registers all of them."""

from rankmill.plans import (  # noqa: F401
    change_queries,
    evaluation_queries,
    fusion_queries,
    lexical_queries,
    monitoring_queries,
    preparation_queries,
    request_queries,
    source_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
from rankmill.plans.registry import ORACLES, QUERIES  # noqa: F401
