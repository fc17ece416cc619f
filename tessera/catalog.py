"""Registered queries by name, and the SQL that DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Register all queries."""
    from tessera.plans import answers, changes, evaluation, integrity, library, lists, reading, relational, reports, retrieval, scoping, search, small, texts, violations  # noqa: F401


load()
