"""Registry of the queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.tables import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of the named views as a query, with the SQL that DuckDB answers it by."""

    def add(f):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def load() -> None:
    from cairn.plans import blocks, control, dml, graph, intervals, rollup, scalars, verify  # noqa: F401


load()
