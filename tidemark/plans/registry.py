"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded double, so sums in another order compare equal."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rsql(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``r`` (adding zero turns -0 into 0)."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0)"
