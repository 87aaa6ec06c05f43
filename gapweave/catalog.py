"""All registered queries and the SQL their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from .plans import rasters, relational, statistics  # noqa: F401  they register themselves
from .plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
