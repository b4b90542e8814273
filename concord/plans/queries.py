"""All queries over the driver's tables, with DuckDB SQL for the same rows where SQL can say it; each module registers its own."""

from __future__ import annotations

from . import scalar_queries, profile_queries, mapping_queries, merge_queries, review_queries, delivery_queries, run_queries, composed_queries, more_queries  # noqa: F401, I001 - in this order
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
