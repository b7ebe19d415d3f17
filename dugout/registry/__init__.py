"""Queries that exercise every operator on the given tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can ask the same, its SQL."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from dugout.registry import (  # noqa: F401
        evaluation, files, learning, scalars, sequences, splits, stages, state, weights,
    )
