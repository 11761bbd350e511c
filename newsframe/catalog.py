"""Registry of queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

from .plans import event_queries, report_queries, table_queries, text_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
