"""Named-query registry: each entry pairs a Spark builder with its DuckDB SQL.

A builder takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables; the SQL (when the operator is SQL-expressible) computes the same rows
in DuckDB over views of the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so that the registry is filled."""
    from . import (q_clean, q_eval, q_group, q_ml, q_profile,  # noqa: F401
                   q_results, q_rules, q_scan, q_sources, q_stream)
    return QUERIES
