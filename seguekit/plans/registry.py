"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seguekit.plans.views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return keep


def with_views(sql: str) -> str:
    """``sql`` after a WITH clause of the views that it names, and of those that they name."""
    used: dict[str, None] = {}

    def visit(text: str) -> None:
        for v in VIEW_SQL:
            if v not in used and re.search(rf"\b{v}\b", text):
                visit(VIEW_SQL[v])
                used[v] = None

    visit(sql)
    if not used:
        return sql
    heads = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"
