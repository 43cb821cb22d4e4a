"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register a query (spark, sf_dir) -> DataFrame, with its SQL if SQL can express it. ints: columns that are 32-bit here, as which
    the SQL's counts and positions are cast."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            narrow = ", ".join(f"CAST({c} AS INT) AS {c}" for c in ints)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({narrow}) FROM ({sql}) AS q" if ints else sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from corpusloom.plans import extra_queries, extraction_queries, library_queries, provenance_queries, rule_queries, similarity_queries, sync_queries, text_queries  # noqa: F401
