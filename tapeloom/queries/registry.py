"""Registered queries: a function over the views, and the SQL its result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tapeloom.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register
