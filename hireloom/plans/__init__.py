"""All registered queries."""

from hireloom.plans import (  # noqa: F401
    catalog_queries,
    document_queries,
    ingest_queries,
    matching_queries,
    resume_queries,
    stream_queries,
    tracking_queries,
)
from hireloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
