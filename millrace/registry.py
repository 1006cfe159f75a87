"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` its result is held against fixtures in the tests."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of the library's plans."""
    import importlib
    import pkgutil

    from millrace import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"millrace.plans.{module.name}")
    return QUERIES, ORACLE_SQL
