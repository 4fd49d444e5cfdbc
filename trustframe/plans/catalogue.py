"""Loads every query module, so that the registry is complete."""

from trustframe.plans import (  # noqa: F401
    audit_queries,
    ground_queries,
    guard_queries,
    knowledge_queries,
    rag_queries,
    review_queries,
    stream_queries,
    tenant_queries,
)
from trustframe.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
