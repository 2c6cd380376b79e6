"""All registered queries of the core, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name; ``sql`` is the same query for DuckDB."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from dialecta.operators import reference_checks, relational  # noqa: F401
    from dialecta.plans import dialect_queries, emit_queries, engine_queries  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["snowflake_qualify"](spark, d)
