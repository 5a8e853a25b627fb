"""Where queries and their oracles are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double so that results compare across engines; adding 0 removes negative zero."""
    cells = [
        f"round(`{f.name}`, {digits}) + 0D AS `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields
    ]
    return df.selectExpr(*cells)
