"""Date parsing, date parts and the integer period axis used by series operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptake.functions.text import strip

ISO_FORMATS = ("yyyy-MM-dd",)
# Year first, or day first. A cell alone does not tell month-first dates from these; a column does, see ``infer_formats``.
DATE_FORMATS = (*ISO_FORMATS, "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy")
# Formats that a column may be written in, month first before day first. Days and months need no leading 0.
KNOWN_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "yyyy-M", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
    "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MMM-d", "MMM yyyy", "MMMM yyyy", "MMM-yyyy")
# A time of day behind a date, with a fraction and a zone; the date is taken as written.
_TIME = r"[T ]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$"
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def parse_date(text: Column, formats=DATE_FORMATS) -> Column:
    """Date of the first format that fits, else NULL. A time of day behind the date is dropped."""
    first, *rest = [F.lit(fmt) for fmt in formats]
    bare = F.regexp_replace(strip(text), _TIME, "")
    # Most cells fit the first format as they are, and the rest is not evaluated.
    tries = [F.try_to_timestamp(text, first), *[F.try_to_timestamp(bare, fmt) for fmt in (first, *rest)]]
    return F.coalesce(*tries).cast("date")


def infer_formats(df: DataFrame, date: Column, candidates=KNOWN_FORMATS) -> tuple[str, ...]:
    """The formats a text column of dates is written in, by the cells themselves.

    That is the one candidate that fits every cell which any of them fits, as a rule. Day-first and month-first
    formats fit each other's cells as long as no day exceeds 12: then the month comes first. In a column of
    several formats it is all that occur, the more frequent first, but of a day-first and a month-first format of
    one separator only the one that fits more cells. Without any date it is ``DATE_FORMATS``.

    One job reads this column alone. Texts are counted before they are parsed, so the work per row is
    a lookup, and only a row of counts comes to the driver.
    """
    texts = df.groupBy(F.regexp_replace(strip(date), _TIME, "").alias("text")).agg(F.count("*").alias("n"))
    fits = [F.try_to_timestamp("text", F.lit(fmt)).isNotNull() for fmt in candidates]
    any_fit = F.sum(F.when(F.array_contains(F.array(*fits), True), F.col("n")))
    *counts, dated = texts.agg(*[F.sum(F.when(fit, F.col("n"))) for fit in fits], any_fit).first()
    ranked = sorted((i for i, n in enumerate(counts) if n), key=lambda i: (-counts[i], i))
    if not ranked:
        return DATE_FORMATS
    if counts[ranked[0]] == dated:
        return (candidates[ranked[0]],)
    kept = []
    for fmt in (candidates[i] for i in ranked):
        if _rival(fmt) not in kept:
            kept.append(fmt)
    return tuple(kept)


def _rival(fmt: str) -> str:
    """The format with day and month exchanged, as far as both are numbers."""
    return fmt if "MMM" in fmt or fmt.startswith("y") else fmt.translate(str.maketrans("Md", "dM"))


def parse_column(df: DataFrame, name: str, formats=None) -> Column:
    """Date of a column of ``df``: text in the given formats, inferred where there are none; other types are cast."""
    date = df[name]
    if df.schema[name].dataType.typeName() != "string":
        return date.cast("date")
    return parse_date(date, formats or infer_formats(df, date))


def parse_year_month(year: Column, month: Column, month_format: str = "MMM") -> Column:
    """First day of a month given a cell with a four digit year and a month name."""
    parts = F.concat_ws("-", digits_year(year).cast("string"), strip(month.cast("string")), F.lit("01"))
    complete = digits_year(year).isNotNull() & month.isNotNull()
    parsed = F.try_to_timestamp(parts, F.lit(f"yyyy-{month_format}-dd")).cast("date")
    return F.when(complete, parsed)


def digits_year(text: Column, pattern: str = r"([0-9]{4})") -> Column:
    """First run of digits that fits the pattern, as an integer, else NULL."""
    found = F.regexp_extract(text.cast("string"), pattern, 1)
    return F.when(found != "", found).try_cast("int")


def month_name(date: Column) -> Column:
    """``Jan`` ... ``Dec``."""
    return F.date_format(date, "MMM")


def month_label(date: Column) -> Column:
    """``Jan 2024``."""
    return F.date_format(date, "MMM yyyy")


def with_month_parts(df, date: str = "Date", name: bool = True):
    """Append Year, Month and optionally Month_Name of a date column."""
    parts = {"Year": F.year(date), "Month": F.month(date)}
    if name:
        parts["Month_Name"] = month_name(F.col(date))
    return df.withColumns(parts)


def period_index(date: Column, grain: str) -> Column:
    """Integer position of a date on the month or day axis; neighbours differ by one."""
    if grain == "month":
        return F.year(date) * 12 + F.month(date) - 1
    if grain == "day":
        return F.unix_date(F.to_date(date))
    raise ValueError(f"unknown grain: {grain}")


def period_date(index: Column, grain: str) -> Column:
    """First date of a position on the month or day axis."""
    if grain == "month":
        # Day 1 of year 0 is position 0 of the month axis.
        return F.add_months(F.lit("0000-01-01").cast("date"), index)
    if grain == "day":
        return F.date_from_unix_date(index)
    raise ValueError(f"unknown grain: {grain}")


def last_period(end, grain: str) -> int:
    """Axis position of the last period of a year, or of a given date."""
    if isinstance(end, int):
        end = dt.date(end, 12, 31)
    if grain == "month":
        return end.year * 12 + end.month - 1
    if grain == "day":
        return (end - dt.date(1970, 1, 1)).days
    raise ValueError(f"unknown grain: {grain}")
