"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("records", "corpus", "events", "release", "provenance", "decoding")
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query (spark, sf_dir) -> DataFrame under a name, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"millrace.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
