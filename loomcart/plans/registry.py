"""Registered queries: a Spark builder and, where SQL can say it, a DuckDB
oracle statement over the same parquet tables.

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
tables.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        queries_catalogue, queries_localise, queries_mutations, queries_orders, queries_payments,
        queries_quality, queries_stock, queries_streaming,
    )
