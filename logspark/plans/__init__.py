"""Composed reports, and the queries registered for the driver with their SQL twins."""

from . import (  # noqa: F401  (they register their queries)
    alert_queries, ingest_queries, search_queries, storage_queries, usage_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
