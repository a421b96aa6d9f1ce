"""Collects queries with the SQL that they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.adapters import VIEWS

Query = Callable[[SparkSession, str], DataFrame]


def _bodies(views: str) -> list[tuple[str, str]]:
    """(name, body) of each common table expression in a list of them."""
    out = []
    for m in re.finditer(r"(\w+) AS (?:MATERIALIZED )?\(", views):
        depth, at = 1, m.end()
        while depth and at < len(views):
            depth += {"(": 1, ")": -1}.get(views[at], 0)
            at += 1
        out.append((m[1], views[m.end() : at - 1]))
    return out


def with_views(sql: str, views: str = "") -> str:
    """The SQL with the common views that it or ``views``, a list of further common table expressions, names in front; recursive only where needed."""
    used: set[str] = set()
    todo = [sql, views]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = (words & VIEWS.keys()) - used
        used |= new
        todo += [VIEWS[n] for n in new]
    parts = [f"{n} AS ({v})" for n, v in VIEWS.items() if n in used] + ([views] if views else [])
    own = any(re.search(rf"\b(?:FROM|JOIN) {n}\b", body) for n, body in _bodies(views))
    return (f"WITH {'RECURSIVE ' if own else ''}" + ", ".join(parts) + " " if parts else "") + sql


class Book:
    """Queries and SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
        """Registers a query under its function's name; ``views`` are more common table expressions for its SQL."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = with_views(sql, views)
            return f

        return keep
