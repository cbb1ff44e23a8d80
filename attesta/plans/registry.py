"""Registry of the named queries and the plain SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.plans.mapping_sql import with_tables
from attesta.sources.lake import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``fn(lake)`` under ``name``; ``needs`` names shared SQL tables the oracle reads."""

    def register(fn: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Lake(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql)
        return fn

    return register
