"""Registered queries: each is a Spark plan over the driver tables and, where
SQL can state it, the DuckDB oracle text that must give the same rows.

``REGISTRY[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
All queries read whole tables; limits appear only where a top-k is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    # importing the modules fills REGISTRY
    from curata.catalog import (identity, scoring, dedup, similarity, summary,  # noqa: F401
                                articles, publication, stored, feeds, daily, runs)


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
