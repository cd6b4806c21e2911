"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
