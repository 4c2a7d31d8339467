"""Registration of checkable queries: a Spark callable and, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.fixtures import EPOCH_DUCKDB, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register a query; ``sql`` is its oracle over the given views."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            if views:
                head = with_views(views, EPOCH_DUCKDB)
                text = f"{head}, {text[5:]}" if text.lower().startswith("with ") else f"{head} {text}"
            ORACLE[name] = text
        return fn

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, as the oracle rounds."""
    if isinstance(column, str):
        return F.round(F.col(column).cast("double"), 6).alias(name or column)
    return F.round(column.cast("double"), 6).alias(name)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    chosen = set(columns)
    return df.select(*[r6(c) if c in chosen else F.col(c) for c in df.columns])


def s6(expression: str, name: str) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"round(cast({expression} as double), 6) + 0.0 as {name}"
