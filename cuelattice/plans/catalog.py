"""All queries of the library."""

from __future__ import annotations

from cuelattice.plans import fold_queries, join_queries, record_queries, store_queries, text_queries, window_queries  # noqa: F401
from cuelattice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
