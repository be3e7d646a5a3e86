"""Named queries with their oracle SQL. Modules of millrace.plans register through `query`."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES: list[str] = ["corpus", "packing", "evaluation", "schemas", "monitoring", "records", "relational", "preparation"]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a (spark, sf_dir) -> DataFrame function, with DuckDB SQL for the same rows where SQL can say it."""

    def add(fn: Query) -> Query:
        if name in _QUERIES and _QUERIES[name].__qualname__ != fn.__qualname__:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"millrace.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
