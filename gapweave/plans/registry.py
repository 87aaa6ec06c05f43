"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with its DuckDB SQL if SQL can express it."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """A rounded column under its own name: sums of floats differ in their last digits between engines."""
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)
