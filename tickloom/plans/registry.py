"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.panels import Panels

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(panels) -> DataFrame under `name`, with the SQL that gives the same rows."""

    def add(fn: Callable[[Panels], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Panels(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add
