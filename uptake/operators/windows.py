"""Change against an earlier row or period, and last-k statistics.

Every window is partitioned by the series keys and runs on aggregated series, whose length is
bounded by the calendar, never on raw facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uptake.functions.dates import period_index
from uptake.functions.numeric import pct_change


def series_window(keys):
    """Window over one series; without keys the whole (calendar-bounded) frame is one series."""
    return Window.partitionBy(*(keys or [F.lit(0)]))


def change_by_row(
    df: DataFrame, value: str, alias: str, order: str, periods: int = 1, keys=(),
    infinite: bool = False,
) -> DataFrame:
    """Percent change against the row ``periods`` earlier in the order.

    A base of 0 gives NULL; with ``infinite`` a nonzero value over a base of 0 gives infinity.
    """
    before = F.lag(F.col(value), periods).over(series_window(keys).orderBy(order))
    return _with_change(df, value, alias, before, infinite)


def change_by_calendar(
    df: DataFrame, value: str, alias: str, date: str, months: int = 12, keys=(),
    infinite: bool = False,
) -> DataFrame:
    """Percent change against exactly ``months`` earlier; NULL where that month has no row.

    A range frame over the month number finds the earlier row without a self-join.
    """
    month = period_index(F.col(date), "month")
    frame = series_window(keys).orderBy(month).rangeBetween(-months, -months)
    return _with_change(df, value, alias, F.max(value).over(frame), infinite)


def _with_change(df, value, alias, before, infinite):
    staged = df.withColumn("__before", before.cast("double"))
    change = pct_change(F.col(value), F.col("__before"))
    if infinite:
        now = F.col(value).cast("double")
        unbounded = (F.col("__before") == 0) & (now != 0)
        change = F.when(unbounded, F.signum(now) * F.lit(float("inf"))).otherwise(change)
    return staged.withColumn(alias, change).drop("__before")


def last_rows(df: DataFrame, order: str, count: int, keys=()) -> DataFrame:
    """The last ``count`` rows of each series in the order."""
    place = F.row_number().over(series_window(keys).orderBy(F.desc(order)))
    return df.withColumn("__place", place).where(F.col("__place") <= count).drop("__place")


def tail_statistics(df: DataFrame, value: str, order: str, count: int, keys=()) -> DataFrame:
    """Mean and population deviation of the last ``count`` rows of each series."""
    tail = last_rows(df, order, count, keys)
    return tail.groupBy(*keys).agg(
        F.avg(value).alias("Tail_Mean"), F.stddev_pop(value).alias("Tail_Std")
    )
