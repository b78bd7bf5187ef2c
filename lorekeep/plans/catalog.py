"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from lorekeep.operators import extraction, graph, logs, lookup, maintenance, retrieval, rules, selection, textops, web  # noqa: F401
from lorekeep.streaming import state  # noqa: F401
from lorekeep.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
