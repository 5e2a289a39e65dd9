"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir), with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _load() -> None:
    from lectern.plans import changes, content, library, metrics, relational, retrieval, sequence, states, streams, study, texts, topics  # noqa: F401


_load()
