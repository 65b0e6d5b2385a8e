"""A query, and the SQL its result is checked against, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, views: tuple[str, ...] = (), sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. `sql` may name the given `views`; they are put in front of it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return add


def with_views(views: tuple[str, ...], sql: str) -> str:
    parts = [view_sql(v) for v in views]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


__all__ = ["ORACLE", "QUERIES", "register", "view", "with_views"]
