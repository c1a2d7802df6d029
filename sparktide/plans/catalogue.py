"""All queries of the engine."""

from __future__ import annotations

from sparktide.plans import artifact_queries, label_queries, time_queries, window_queries  # noqa: F401  register their queries
from sparktide.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
