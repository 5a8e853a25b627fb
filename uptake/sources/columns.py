"""Column names: cleaning, de-duplication, discovery by keyword, required roles.

All of this is schema metadata on the driver; no job runs.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

# What each awkward character of a column name turns into.
NAME_CHARACTERS = {" ": "_", "/": "_", "-": "_", "%": "Percent", ".": ""}
_TRANSLATION = str.maketrans(NAME_CHARACTERS)

DATE_PARTS = ("year", "month", "date")


def unique_names(names) -> list[str]:
    """Trim names and number repeats: the second ``x`` is ``x_1``, the third ``x_2``."""
    met: Counter[str] = Counter()
    result = []
    for name in (str(raw).strip() for raw in names):
        repeat = met[name]
        met[name] += 1
        result.append(f"{name}_{repeat}" if repeat else name)
    return result


def clean_names(names) -> list[str]:
    """Names without spaces, slashes, dashes, percent signs and dots, made unique."""
    return unique_names(str(name).strip().translate(_TRANSLATION) for name in names)


def with_clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def find_column(columns, keywords) -> str | None:
    """First column, in column order, whose name holds any keyword, ignoring case."""
    wanted = [word.lower() for word in keywords]
    hits = (name for name in columns if any(word in str(name).lower() for word in wanted))
    return next(hits, None)


def year_columns(columns, strict: bool = True) -> list[str]:
    """Financial year columns: ``FY`` and four digits, or with ``strict=False`` any ``FY`` prefix."""
    pattern = re.compile(r"FY\d{4}\Z" if strict else r"FY")
    return [name for name in columns if pattern.match(str(name))]


def category_columns(columns, exclude=()) -> list[str]:
    """Columns with ``electric`` in the name that are neither totals nor date parts."""
    skipped = set(exclude) | {"Date"}
    return [
        name for name in columns
        if name not in skipped and "electric" in name.lower() and "total" not in name.lower()
    ]


def require(roles: dict[str, str | None], what: str) -> None:
    """Raise with the list of roles for which no column was found."""
    missing = [role for role, column in roles.items() if column is None]
    if missing:
        raise ValueError(f"{what}: no column found for {missing}")
