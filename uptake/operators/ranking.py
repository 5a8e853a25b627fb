"""Ordering, top-k and arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def descending(*columns: str) -> list[Column]:
    """Largest first, NULL last."""
    return [F.desc_nulls_last(name) for name in columns]


def ascending(*columns: str) -> list[Column]:
    """Smallest first, NULL last."""
    return [F.asc_nulls_last(name) for name in columns]


def top_k(df: DataFrame, by: str, k: int, tie_break) -> DataFrame:
    """The k rows with the largest value; the tie break makes the result unique.

    Sort and limit together plan as a heap per partition, not as a full sort.
    """
    return df.orderBy(*descending(by), *ascending(*tie_break)).limit(k)


def head(df: DataFrame, by, k: int) -> DataFrame:
    return df.orderBy(*ascending(*by)).limit(k)


def tail(df: DataFrame, by, k: int) -> DataFrame:
    """The last k rows of the ascending order."""
    return df.orderBy(*[F.desc_nulls_first(name) for name in by]).limit(k)


def arg_max(df: DataFrame, by: str, tie_break: str, columns=None) -> DataFrame:
    """The one row with the largest value, smallest tie break first."""
    return top_k(df, by, 1, [tie_break]).select(*(columns or df.columns))


def latest_rows(df: DataFrame, order: str) -> DataFrame:
    """One row: that with the largest value of ``order``, by aggregation instead of a sort."""
    return df.agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")
