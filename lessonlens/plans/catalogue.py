"""The list of runnable queries and their check texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lessonlens.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, **steps: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may read the fixture views and the named ``steps``."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(sql, **steps)
        return fn

    return add
