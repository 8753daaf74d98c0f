"""How queries are registered: a Spark function and, where SQL can express it, the same result as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def duck(text: str) -> str:
    """Shared expression text in DuckDB's spelling: no suffix on double literals."""
    return re.sub(r"(\d)D\b", r"\1", text)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return add


def r(expr: str, digits: int = 6) -> str:
    """Rounded, so that sums taken in another order agree; never minus zero."""
    return f"round({expr}, {digits}) + cast(0 AS double)"


def cols(named: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in named.items())


def select(df: DataFrame, named: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{v} AS {k}" for k, v in named.items()])
