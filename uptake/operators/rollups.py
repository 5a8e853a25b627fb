"""Grouped and global aggregates. All of them combine on the map side before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptake.functions.numeric import total


def sum_by(df: DataFrame, keys, value: str, alias: str | None = None) -> DataFrame:
    """Sum per key; a group of only NULL values gives 0. A NULL key forms its own group."""
    return df.groupBy(*keys).agg(total(F.col(value)).alias(alias or value))


def total_where(condition: Column, value: Column) -> Column:
    """Sum of the rows that fit a condition, 0 if none does."""
    return total(F.when(condition, value))


def sums_where(df: DataFrame, keys, value: str, needed=(), **conditions: Column) -> DataFrame:
    """One sum per condition side by side, 0 where no row fits, in one pass and one shuffle.

    This is the merge of filtered and summed copies of one frame. Groups without any row for a condition
    named in ``needed`` are left out, as an inner join would.
    """
    amount = F.col(value).cast("double")
    met = {name: f"__{name}" for name in needed}
    out = df.groupBy(*keys).agg(
        *[total_where(condition, amount).alias(name) for name, condition in conditions.items()],
        *[F.count_if(conditions[name]).alias(alias) for name, alias in met.items()],
    )
    for alias in met.values():
        out = out.where(F.col(alias) > 0)
    return out.drop(*met.values())


def positive_count(value: Column) -> Column:
    """Number of rows with a value above 0."""
    return F.count_if(value > 0)


def value_counts(df: DataFrame, column: str, alias: str = "Count") -> DataFrame:
    """Frequency of each value, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias(alias))
    return counts.orderBy(F.desc(alias), F.asc_nulls_last(column))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def shape(df: DataFrame) -> DataFrame:
    """One row with the number of rows and columns."""
    return df.agg(F.count("*").alias("Rows"), F.lit(len(df.columns)).alias("Columns"))


def latest_complete_year(df: DataFrame, date: str = "Date", months: int = 12) -> DataFrame:
    """One row: the last year with data in all months, else the last year at all.

    Rows collapse to one per year and month on the map side, so the second level sees at most
    twelve rows per year however large the input is.
    """
    per_month = df.where(F.col(date).isNotNull()).groupBy(
        F.year(date).alias("Year"), F.month(date).alias("Month")
    ).agg(F.lit(1).alias("Seen"))
    per_year = per_month.groupBy("Year").agg(F.count("*").alias("Months"))
    complete = F.max(F.when(F.col("Months") >= months, F.col("Year")))
    return per_year.agg(F.coalesce(complete, F.max("Year")).alias("Latest_Complete_Year"))


def default_year(df: DataFrame, preferred: int, year: str = "Year") -> DataFrame:
    """One row: the preferred year if the data has it, else the last year."""
    hit = F.max(F.when(F.col(year) == preferred, F.col(year)))
    return df.agg(F.coalesce(hit, F.max(year)).alias("Default_Year"))
