"""From raw monthly and state tables to the long frames every report starts from."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.functions import dates
from uptake.functions.labels import fuel_label, is_ev_fuel, monthly_category, state_name
from uptake.functions.numeric import as_number, fill_and_clip, fill_zero, total
from uptake.operators.reshape import melt_labelled
from uptake.operators.rollups import sum_by
from uptake.operators.rows import drop_totals
from uptake.plans.variants import DEFAULT, Variant
from uptake.sources.columns import category_columns, find_column, require, with_clean_columns


class Monthly(NamedTuple):
    categories: DataFrame
    totals: DataFrame
    unparsed: DataFrame  # one row: Rows, and Unparsed_Dates, the rows left out for their date


class StateMonthly(NamedTuple):
    rows: DataFrame
    electric: DataFrame
    all_fuels: DataFrame
    unparsed: DataFrame  # as in Monthly


def _unparsed(dated):
    return dated.agg(F.count("*").alias("Rows"), F.count_if(F.col("Date").isNull()).alias("Unparsed_Dates"))


def _measure(df, name, variant):
    amount = as_number(df, name, variant.number_markers)
    return fill_and_clip(amount) if variant.clip_negative else fill_zero(amount)


def _table_date(df, formats, month_format):
    """The date column if there is one, else the first of the month of the year and month columns."""
    year, month = find_column(df.columns, ["Year"]), find_column(df.columns, ["Month"])
    date = find_column(df.columns, ["Date"])
    if date:
        parsed = dates.parse_column(df, date, formats)
    else:
        require({"year": year, "month": month}, "monthly table without a date column")
        parsed = dates.parse_year_month(df[year], df[month], month_format)
    return parsed, [name for name in (year, month, date) if name]


def monthly_categories(
    table: DataFrame, variant: Variant = DEFAULT, date_formats=None, month_format: str = "MMM",
) -> Monthly:
    """Wide monthly table to category and total series. The formats of a date column of texts are inferred from it unless given.

    The wide columns are summed per date first and unpivoted afterwards, so the shuffle carries one
    narrow row per date and task whatever the number of categories. The total is the total column
    if there is one, else the sum of the categories.
    """
    df = drop_totals(with_clean_columns(table))
    parsed, date_names = _table_date(df, date_formats, month_format)
    categories = category_columns(df.columns, exclude=date_names)
    if not categories:
        raise ValueError("no electric category column found")
    total_name = find_column(df.columns, ["Total_Registration", "Total Registration", "Total"])

    measured = categories + ([total_name] if total_name else [])
    staged = df.select(parsed.alias("Date"), *[_measure(df, c, variant).alias(c) for c in measured])
    per_date = staged.where(F.col("Date").isNotNull()).groupBy("Date").agg(
        *[total(F.col(c)).alias(c) for c in measured]
    )
    labels = {c: monthly_category(F.lit(c), variant.category_style) for c in categories}
    long = melt_labelled(per_date, ["Date"], labels, "Category", "EV_Registrations")
    by_category = sum_by(long, ["Date", "Category"], "EV_Registrations")
    if total_name:
        totals = per_date.select("Date", F.col(total_name).alias("EV_Registrations"))
    else:
        totals = sum_by(by_category, ["Date"], "EV_Registrations")
    return Monthly(dates.with_month_parts(by_category), dates.with_month_parts(totals), _unparsed(staged))


def _state_columns(df) -> dict[str, str]:
    roles = {
        "date": find_column(df.columns, ["date"]),
        "state": find_column(df.columns, ["state_name", "state"]),
        "fuel": find_column(df.columns, ["fuel_type", "fuel"]),
        "registrations": find_column(df.columns, ["registrations", "registration"]),
    }
    require(roles, "state monthly table")
    return roles


def state_sums(table: DataFrame, variant: Variant = DEFAULT) -> DataFrame:
    """A state table summed per raw date, state and fuel text: a calendar's worth of rows that stands for the table in
    ``state_months`` (all but the count of unparsed rows), so that inferring its date formats does not read the facts again."""
    df = with_clean_columns(table)
    roles = _state_columns(df)
    keys = [F.col(roles[r]).alias(r) for r in ("date", "state", "fuel")]
    return df.groupBy(*keys).agg(total(_measure(df, roles["registrations"], variant)).alias("registrations"))


def state_months(
    table: DataFrame, variant: Variant = DEFAULT, date_formats=None,
) -> StateMonthly:
    """State table to cleaned rows, electric months and all-fuel months. The formats of a date column of
    texts are inferred from it unless given.

    The two aggregates sum per raw label and date first and clean the labels of the few resulting
    rows; the text work does not grow with the facts, and a state holding a third of them leaves
    each task as one row per date.
    """
    df = with_clean_columns(table)
    roles = _state_columns(df)
    dated = df.select(
        dates.parse_column(df, roles["date"], date_formats).alias("Date"),
        df[roles["state"]].cast("string").alias("State"),
        df[roles["fuel"]].cast("string").alias("Fuel_Type"),
        _measure(df, roles["registrations"], variant).alias("Registrations"),
    )
    staged = dated.where(F.col("Date").isNotNull())

    def labelled(frame):
        return dates.with_month_parts(frame.withColumns({
            "State": state_name(F.col("State"), variant.state_style),
            "Is_EV": is_ev_fuel(F.col("Fuel_Type"), variant.ev_match),
            "Fuel_Type": fuel_label(F.col("Fuel_Type"), variant.state_fuel_style),
        }), name=False)

    compact = labelled(
        staged.groupBy("State", "Fuel_Type", "Date").agg(
            total(F.col("Registrations")).alias("Registrations")
        )
    )
    keys = ["State", "Date", "Year", "Month"]
    electric = sum_by(compact.where("Is_EV"), keys, "Registrations", "EV_Registrations")
    all_fuels = sum_by(compact, keys, "Registrations", "Total_Registrations")
    return StateMonthly(labelled(staged), electric, all_fuels, _unparsed(dated))
