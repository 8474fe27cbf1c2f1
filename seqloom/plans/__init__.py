"""Registered queries: composed plans over the tables, each beside the SQL it is held against."""

from __future__ import annotations

import importlib

_MODULES = ("corpus", "labelling", "statistics", "metadata", "documents", "selection")


def registered() -> tuple[dict, dict]:
    """All queries and all SQL of the plan modules."""
    queries, sql = {}, {}
    for name in _MODULES:
        module = importlib.import_module(f"seqloom.plans.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql
