"""Wide to long, long to wide, and stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.functions.dates import MONTH_NAMES


def melt(df: DataFrame, ids, values, name: str, value: str) -> DataFrame:
    """One row per id and value column; NULL cells are kept."""
    return df.unpivot(list(ids), list(values), name, value)


def melt_labelled(df: DataFrame, ids, labels: dict, name: str, value: str) -> DataFrame:
    """Like ``melt``, with a label expression given for each value column.

    The labels depend on column names only, so they fold to literals while the plan is built.
    """
    cells = F.array(*[
        F.struct(label.alias(name), F.col(f"`{column}`").alias(value))
        for column, label in labels.items()
    ])
    return df.select(*ids, F.inline(cells))


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def seasonality(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Year by month matrix of sums with columns Jan ... Dec; a month without rows is NULL.

    The months are a fixed domain, so no extra job looks for them and partial sums leave the map
    side as one row per key and year.
    """
    cells = [
        F.sum(F.when(F.col("Month") == number, F.col(value))).alias(name)
        for number, name in enumerate(MONTH_NAMES, start=1)
    ]
    return df.groupBy(*keys, "Year").agg(*cells)
