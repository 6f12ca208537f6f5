"""Names, plans and oracle SQL of the engine's own queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("core_queries", "retrieval_queries", "analysis_queries")


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its own name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"spanquarry.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
