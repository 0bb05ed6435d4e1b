"""Every registered query and its DuckDB twin, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (session, folder) under its name; sql: what DuckDB would say."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from tidemark.plans import audit_queries, evaluation_queries, feature_queries, ingest_queries, name_queries, table_queries, wiki_queries  # noqa: F401
