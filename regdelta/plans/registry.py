"""Queries over the given tables and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with SQL for DuckDB if there is any."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# the modules below register their queries
from regdelta.plans import change_queries, event_queries, source_queries  # noqa: E402, F401
