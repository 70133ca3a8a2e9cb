"""A module's queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """(queries, sql, decorator that registers a query under its function's name with its SQL)."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
