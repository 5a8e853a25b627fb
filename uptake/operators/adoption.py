"""Growth and penetration tables over the yearly long fact.

Each table is one pass with conditional sums instead of separate filtered copies joined together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.functions import numeric
from uptake.functions.labels import ALL_VEHICLES
from uptake.functions.text import strip
from uptake.operators.ranking import ascending, descending
from uptake.operators.rollups import total_where


def national_growth(yearly: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """One row: electric registrations of two years, overall growth and CAGR."""
    ev = yearly.where(
        F.col("Is_EV") & (F.col("Category") == ALL_VEHICLES)
        & F.col("Year").isin(start_year, end_year)
    )
    value = F.col("Registrations").cast("double")
    ends = ev.agg(
        total_where(F.col("Year") == start_year, value).alias("Start_EV_Registrations"),
        total_where(F.col("Year") == end_year, value).alias("End_EV_Registrations"),
    )
    start, end = F.col("Start_EV_Registrations"), F.col("End_EV_Registrations")
    return ends.select(
        F.lit(start_year).alias("Start_Year"),
        F.lit(end_year).alias("End_Year"),
        start, end,
        numeric.overall_growth(start, end).alias("Overall_Growth_Percent"),
        numeric.cagr(start, end, end_year - start_year).alias("CAGR_Percent"),
    )


def category_growth(
    yearly: DataFrame, start_year: int, end_year: int, outer: bool = True,
    names=("Start_EV_Registrations", "End_EV_Registrations"),
) -> DataFrame:
    """Electric CAGR per category, best first.

    ``outer`` keeps categories with rows in only one of the years (the other side is 0); otherwise
    both are needed.
    """
    ev = yearly.where(
        F.col("Is_EV") & (F.col("Category") != ALL_VEHICLES)
        & F.col("Year").isin(start_year, end_year)
    )
    at_start, at_end = F.col("Year") == start_year, F.col("Year") == end_year
    value = F.col("Registrations").cast("double")
    ends = ev.groupBy("Category").agg(
        total_where(at_start, value).alias(names[0]),
        total_where(at_end, value).alias(names[1]),
        F.count_if(at_start).alias("__start_rows"),
        F.count_if(at_end).alias("__end_rows"),
    )
    if not outer:
        ends = ends.where((F.col("__start_rows") > 0) & (F.col("__end_rows") > 0))
    growth = numeric.cagr(F.col(names[0]), F.col(names[1]), end_year - start_year)
    return (
        ends.select("Category", *names, growth.alias("CAGR_Percent"))
        .orderBy(*descending("CAGR_Percent"), *ascending("Category"))
    )


def penetration(yearly: DataFrame) -> DataFrame:
    """Electric share of the Total rows per category and year.

    A category and year without a Total row is left out; one without electric rows shows 0.
    """
    is_total = F.lower(strip(F.col("Fuel_Type"))) == "total"
    is_ev = F.coalesce(F.col("Is_EV"), F.lit(False))
    value = F.col("Registrations").cast("double")
    sums = (
        yearly.where(is_total | is_ev)
        .groupBy("Category", "Year")
        .agg(
            total_where(is_total, value).alias("Total_Registrations"),
            total_where(is_ev, value).alias("EV_Registrations"),
            F.count_if(is_total).alias("__totals"),
        )
        .where(F.col("__totals") > 0)
    )
    share = numeric.share_percent(F.col("EV_Registrations"), F.col("Total_Registrations"))
    return sums.select(
        "Category", "Year", "Total_Registrations", "EV_Registrations",
        share.alias("EV_Penetration_Percent"),
    )


def national_penetration(table: DataFrame, first: int | None = None, last: int | None = None):
    """The All Vehicles rows in year order, optionally within an inclusive range of years."""
    rows = table.where(F.col("Category") == ALL_VEHICLES)
    if first is not None:
        rows = rows.where(F.col("Year") >= first)
    if last is not None:
        rows = rows.where(F.col("Year") <= last)
    return rows.orderBy("Year")


def category_penetration(table: DataFrame, year: int | None = None) -> DataFrame:
    """All other rows by year, highest share first; optionally of one year."""
    rows = table.where(F.col("Category") != ALL_VEHICLES)
    if year is not None:
        rows = rows.where(F.col("Year") == year)
    return rows.orderBy(
        *ascending("Year"), *descending("EV_Penetration_Percent"), *ascending("Category")
    )
