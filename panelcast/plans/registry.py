"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a survey name, with its DuckDB SQL if it has one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        MODULES[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def rnd(c, digits: int = 6):
    """Round and drop negative zero, as both engines print it the same way then."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits) + F.lit(0.0)
