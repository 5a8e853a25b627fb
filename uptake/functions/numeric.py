"""Number cleaning and growth arithmetic. A missing or impossible result is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text markers deleted from a number cell before it is parsed, per variant.
MARKERS_DEFAULT = ("NA", "nan")
MARKERS_DASHBOARD = ("NA", "na")
MARKERS_BATCH = ("NA",)

# Spark would also read '1d' or '1f' as a number, so the whole text must look like one. White space
# of any kind may surround it.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
_NUMBER = (
    rf"\A{_SPACE}([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?)))"
    rf"{_SPACE}\z"
)


def clean_num(text: Column, markers=MARKERS_DEFAULT) -> Column:
    """Parse a dirty number cell: thousands separators and missing markers go, failures are NULL."""
    bare = F.replace(text.cast("string"), F.lit(","), F.lit(""))
    for marker in markers:
        bare = F.replace(bare, F.lit(marker), F.lit(""))
    number = F.regexp_extract(bare, _NUMBER, 1)
    # Only text that is a number reaches the cast, whose failures are slow.
    parsed = F.when(number != "", number).try_cast("double")
    # A finite literal beyond the range of a double overflows to infinity: not a number we keep.
    finite = F.abs(parsed) < F.lit(float("inf"))
    return F.when(finite | F.lower(number).contains("inf"), parsed)


def as_number(df: DataFrame, name: str, markers=MARKERS_DEFAULT) -> Column:
    """``clean_num`` for text columns, a plain cast for columns that already are numbers."""
    kind = df.schema[name].dataType
    cell = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = cell.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.NumericType):
        return cell.cast("double")
    return clean_num(cell, markers)


def fill_zero(value: Column) -> Column:
    """NULL becomes 0."""
    return F.coalesce(value, F.lit(0.0))


def clip_low(value: Column, floor: float = 0.0) -> Column:
    """Raise values below ``floor``; NULL stays NULL (``greatest`` alone would turn it into floor)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))


def fill_and_clip(value: Column) -> Column:
    """NULL and negative values become 0."""
    return F.greatest(fill_zero(value), F.lit(0.0))


def total(value: Column) -> Column:
    """Sum where an empty or all-NULL group gives 0."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def share_percent(part: Column, whole: Column) -> Column:
    """part / whole in percent; NULL if the whole is 0 or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def pct_change(current: Column, previous: Column) -> Column:
    """Relative change in percent; NULL if a side is missing or the base is 0."""
    base = previous.cast("double")
    return F.try_divide(current.cast("double") - base, base) * 100


def overall_growth(start: Column, end: Column) -> Column:
    """Relative change in percent from a start that must be positive."""
    return F.when(start > 0, pct_change(end, start))


def cagr(start: Column, end: Column, years) -> Column:
    """Compound annual growth in percent.

    NULL for a missing side, a start or span that is not positive, or a negative end (whose root
    is not a real number). An end of 0 gives -100.
    """
    span = years if isinstance(years, Column) else F.lit(years)
    first = start.cast("double")
    last = end.cast("double")
    usable = (first > 0) & (last >= 0) & (span > 0)
    ratio = F.try_divide(last, first)
    root = F.try_divide(F.lit(1.0), span.cast("double"))
    return F.when(usable, (F.pow(ratio, root) - 1) * 100)
