"""Names of the library's own queries, with the DuckDB text for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs for the same rows."""

    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from arbolita.plans import mission_queries, order_queries, reports, stream_queries, text_queries, training_queries, tree_queries, xml_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
