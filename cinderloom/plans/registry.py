"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderloom.sources.tables import SQL_TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``tables`` are the logical tables its SQL is over."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            views = ",\n".join(SQL_TABLES[t] for t in tables.split())
            body = sql.strip()
            if views:
                body = f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views}\n{body}"
            SQL[f.__name__] = body
        return f

    return add
