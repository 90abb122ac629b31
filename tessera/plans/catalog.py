"""Every registered query of the engine's own operators, with its SQL twin."""

from __future__ import annotations

from . import audit, building, details, discovery, graph, knowledge, retrieval, routing, search, statistics, structure, text, upkeep  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES, Query

__all__ = ["ORACLE_SQL", "QUERIES", "Query"]
