"""Registered queries of the retrieval engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows where SQL can."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from lumenlog.plans import context, logs, retrieval, shown, stored  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
