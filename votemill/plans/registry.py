"""One registry of runnable queries: name -> (Spark function over bound tables, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from votemill.plans.bind import Bound, with_ctes

QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    from votemill.plans import queries_blocks, queries_core, queries_published, queries_sources  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Bound.over(spark, sf_dir))) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
