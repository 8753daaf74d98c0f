"""Columns that build on each other, applied to a DataFrame or nested as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[dict[str, str]]


def apply(df: DataFrame, steps: Steps) -> DataFrame:
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


def nest(source: str, steps: Steps) -> str:
    """SQL text of the same columns over a table name or a parenthesised query."""
    for k, step in enumerate(steps):
        source = f"(SELECT *, {', '.join(f'{v} AS {n}' for n, v in step.items())} FROM {source} s{k})"
    return source
