"""The catalogue: each query as (function, SQL that must give the same rows, or None)."""

from __future__ import annotations

from concordia.plans import aggregate_queries, clause_queries, evidence_queries, line_queries, matching_queries, scoring_queries, value_queries

_MODULES = (line_queries, matching_queries, aggregate_queries, value_queries, evidence_queries, scoring_queries, clause_queries)


def catalogue() -> dict:
    found = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found
