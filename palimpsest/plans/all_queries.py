"""All registered queries."""

from __future__ import annotations

from . import graph_queries, memory_queries, stream_queries, table_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "memory_queries", "stream_queries", "table_queries"]
