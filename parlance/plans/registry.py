"""Register a query together with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.sources.tables import VIEWS, Tables, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CHECK_VIEWS: dict[str, str] = {}  # extra common table expressions of the checks


def check_view(name: str, sql: str) -> None:
    CHECK_VIEWS[name] = sql.strip()


def _with_views(sql: str) -> str:
    need: list[str] = []

    def visit(text: str) -> None:
        for n in re.findall(r"\b(?:fx|ck)_\w+\b", text):
            if n in need or (n not in VIEWS and n not in CHECK_VIEWS):
                continue
            visit(CHECK_VIEWS.get(n, ""))
            need.append(n)

    visit(sql)
    if not need:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({CHECK_VIEWS[n] if n in CHECK_VIEWS else view_sql(n)})" for n in need)
    body = sql.strip()
    if start := re.match(r"(?i)with(\s+recursive)?\b", body):
        return f"{start[0]} {ctes},\n{body[start.end():].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql:
            _SQL[name] = sql
        return fn
    return add


def oracle() -> dict[str, str]:
    """Check SQL of every query, with the views it reads written out in front."""
    return {name: _with_views(sql) for name, sql in _SQL.items()}
