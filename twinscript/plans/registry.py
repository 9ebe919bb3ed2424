"""Registered queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from twinscript.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

MODULES = ["textual", "catalogue", "matching", "aligning", "bitexts", "language", "annotation",
           "exchange", "incremental"]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the equivalent SQL if there is one."""
    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return fn
    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"twinscript.plans.queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
