"""Where queries are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def enter(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is there already")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return enter


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
