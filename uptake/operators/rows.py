"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uptake.functions.text import strip

# Cell texts that mark a totals row.
TOTAL_LABELS = ("total", "grand total")

# NBSP, read as a space, and the zero-width space, deleted.
_BLANKS = chr(0xA0) + chr(0x200B)


def drop_totals(df: DataFrame) -> DataFrame:
    """Drop rows in which any text column says Total or Grand Total.

    Case, white space of any kind around the text and zero-width spaces do not matter.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    marks = [
        F.coalesce(
            F.lower(strip(F.translate(F.col(f"`{name}`"), _BLANKS, " "))).isin(*TOTAL_LABELS),
            F.lit(False),
        )
        for name in texts
    ]
    return df.where(~reduce(lambda a, b: a | b, marks))


def drop_missing(df: DataFrame, columns) -> DataFrame:
    """Keep rows in which every given column has a value."""
    return df.dropna(subset=list(columns))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is NULL."""
    return df.dropna("all")


def exclude_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Drop rows whose text holds the pattern, ignoring case; NULL stays."""
    return df.where(~F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def in_band(first: int, last: int | None, row_no: str) -> Column:
    """Whether an explicit row number lies from ``first`` to ``last`` inclusive; NULL never does."""
    number = F.col(row_no)
    return F.coalesce(number >= first if last is None else number.between(first, last), F.lit(False))


def row_band(df: DataFrame, first: int, last: int | None, row_no: str) -> DataFrame:
    """Rows from ``first`` to ``last`` inclusive, or to the end, by explicit row number."""
    return df.where(in_band(first, last, row_no))


def keep_members(df: DataFrame, column: str, members) -> DataFrame:
    """Keep rows whose value is in a short list, or in the first column of a DataFrame.

    The members are made distinct before the join, so a repeated one cannot pile up in a task; a
    value that many rows hold is split by AQE on the side of the rows.
    """
    if isinstance(members, DataFrame):
        wanted = members.select(F.col(members.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(*members))
