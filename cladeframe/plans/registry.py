"""Registered queries: name → (DataFrame builder, SQL for the check or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeframe.plans.tables import Tables

_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under the operator's name."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = (fn, sql)
        return fn

    return add


def _load() -> None:
    from cladeframe.plans import features, lookups, alignments, forests, files  # noqa: F401


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, (fn, _) in _QUERIES.items()}


def checks() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
