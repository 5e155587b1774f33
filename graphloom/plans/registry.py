"""Queries over the lens, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..lens import SQL, Lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register ``f(lens)`` by its name; ``sql`` follows the lens tables (more of them after a leading comma)."""

    def add(f: Callable[[Lens], DataFrame]) -> Callable[[Lens], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = SQL.rstrip() + ("" if sql.lstrip().startswith(",") else "\n") + sql
        return f

    return add
