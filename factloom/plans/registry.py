"""All queries of the core and their SQL."""

from __future__ import annotations

from factloom.plans import corpus_queries, fact_queries, scan_queries, verdict_queries
from factloom.plans.fact_queries import flagship

MODULES = [fact_queries, verdict_queries, scan_queries, corpus_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}


__all__ = ["flagship", "oracle_sql", "queries"]
