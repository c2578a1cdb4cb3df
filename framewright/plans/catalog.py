"""All queries of the library outside the llm subpackage, and their SQL."""

from __future__ import annotations

from framewright.plans import metadata, ranges, roles, signals, streams, tables, time
from framewright.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "delta_gather"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "metadata", "ranges", "roles", "signals", "streams", "tables", "time"]
