"""All registered queries of the core operators."""

from __future__ import annotations

from sieveloom.plans import analytics_queries, answer_queries, collection_queries, declaration_queries, evaluation_queries, hybrid_queries, lexical_queries, ranking_queries  # noqa: F401
from sieveloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
