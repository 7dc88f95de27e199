"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; both engines sum doubles in their own order."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def R(expr: str, digits: int = 6) -> str:  # noqa: N802
    """The SQL twin of ``r``; adding zero turns -0.0 into 0.0."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"
