"""Sheet layouts that carry meaning in row positions: bands and stacked headers.

A grid is a DataFrame of text cells plus a ``row_no`` column (see ``readers.read_grid``).
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptake.functions.dates import digits_year
from uptake.functions.labels import ALL_VEHICLES, state_name, wheel_category
from uptake.functions.labels import fuel_label, is_ev_fuel
from uptake.functions.numeric import clean_num, fill_zero, total
from uptake.operators.reshape import melt, melt_labelled
from uptake.operators.rows import drop_totals, in_band, row_band
from uptake.plans.variants import DEFAULT, Variant
from uptake.sources.columns import find_column, unique_names, year_columns
from uptake.sources.readers import ROW_NO

HEAD_ROWS = 8


def promote_header(grid: DataFrame, at: int = 0, row_no: str = ROW_NO) -> DataFrame:
    """Use one row of the grid as column names; later rows count from 0 again."""
    cells = [name for name in grid.columns if name != row_no]
    head = grid.where(F.col(row_no) == at).select(*cells).first()
    if head is None:
        raise ValueError(f"the grid has no row {at}")
    names = unique_names(value or f"Unnamed: {i}" for i, value in enumerate(head))
    body = row_band(grid, at + 1, None, row_no)
    return body.select(
        *[F.col(cell).alias(name) for cell, name in zip(cells, names)],
        (F.col(row_no) - (at + 1)).alias(row_no),
    )


def bands_to_long(
    sheet: DataFrame,
    labels: tuple[str, str],
    variant: Variant = DEFAULT,
    national: tuple[int, int] = (0, 3),
    categories_from: int = 7,
    row_no: str = ROW_NO,
) -> DataFrame:
    """Yearly sheet with a national and a category band to a long fact.

    ``labels`` names the category and fuel columns. Rows of the national band are "All Vehicles";
    category rows need both labels. Result: Category, Fuel_Type, Financial_Year, Year, Is_EV,
    Registrations.
    """
    years = year_columns(sheet.columns, strict=variant.strict_year_columns)
    if not years:
        raise ValueError("the sheet has no financial year columns")
    named = sheet.select(
        F.col(f"`{labels[0]}`").alias("Category"), F.col(f"`{labels[1]}`").alias("Fuel_Type"),
        *years, row_no,
    )
    # Both bands in one pass: the national rows get their label in place.
    top = in_band(*national, row_no)
    rest = in_band(categories_from, None, row_no) & F.col("Category").isNotNull() & F.col("Fuel_Type").isNotNull()
    if variant.drop_footers:
        rest = rest & ~F.coalesce(F.col("Category").rlike("(?i)source|category"), F.lit(False))
    rows = named.where(top | rest).withColumn("Category", F.when(top, F.lit(ALL_VEHICLES)).otherwise(F.col("Category")))
    rows = rows.drop(row_no)

    if variant.standard_wheel_labels:
        rows = rows.withColumn("Category", wheel_category(F.col("Category"), variant.wheel_aliases))
    rows = rows.withColumns({
        "Is_EV": is_ev_fuel(F.col("Fuel_Type"), variant.ev_match),
        "Fuel_Type": fuel_label(F.col("Fuel_Type"), variant.yearly_fuel_style),
    })
    # The cells are parsed while still wide: parsing right above the unpivot trips Spark's code
    # generator (it splits shared subexpressions on the unpivot's array state).
    parsed = {y: fill_zero(clean_num(F.col(y), variant.number_markers)) for y in years}
    ids = ["Category", "Fuel_Type", "Is_EV"]
    long = melt(rows.withColumns(parsed), ids, years, "Financial_Year", "Registrations")
    long = long.withColumn("Year", digits_year(F.col("Financial_Year")))
    keys = ["Category", "Fuel_Type", "Financial_Year", "Year", "Is_EV"]
    if not variant.merge_yearly_rows:
        return long.select(*keys, "Registrations")
    return long.groupBy(*keys).agg(total(F.col("Registrations")).alias("Registrations"))


def stacked_header(head: list[list[str | None]]) -> tuple[int, list[str]]:
    """Position of the header row that names the state column, and one name per grid column.

    The row above holds the fuel, written only over the first of its columns; names are
    ``fuel_year``.
    """
    rows = [[("" if cell is None else str(cell)) for cell in row] for row in head[:HEAD_ROWS]]
    at = next((i for i, row in enumerate(rows) if any("state" in c.lower() for c in row)), None)
    if at is None:
        raise ValueError(f"no state header within the first {HEAD_ROWS} rows")
    fuels = accumulate(rows[max(at - 1, 0)], lambda carried, cell: cell or carried)
    names = []
    for fuel, year in zip(fuels, rows[at]):
        parts = [p for p in (fuel.strip(), year.strip()) if p.lower() not in ("", "nan", "none")]
        names.append("State" if "state" in year.lower() else "_".join(parts) or "Blank")
    return at, unique_names(names)


def stacked_header_to_long(grid: DataFrame, variant: Variant = DEFAULT) -> DataFrame:
    """Reference table with fuel row above year row to (State, Year, Reference_EV_Registrations).

    Only the few head rows come to the driver, as column metadata. The cells are summed per raw
    state text before they are turned into rows, so the shuffle carries one row per state, not one
    per cell.
    """
    cells = [name for name in grid.columns if name != ROW_NO]
    # A limit without an order stops at the first split; the rows are ordered here.
    head = grid.where(F.col(ROW_NO) < HEAD_ROWS).limit(HEAD_ROWS).collect()
    head.sort(key=lambda row: row[ROW_NO])
    at, names = stacked_header([[row[c] for c in cells] for row in head])

    body = row_band(grid, at + 1, None, ROW_NO).select(
        *[F.col(cell).alias(name) for cell, name in zip(cells, names)]
    )
    body = drop_totals(body.dropna("all"))
    state = find_column(names, ["State"])
    years = {
        name: int(found.group(1)) for name in names
        if "electric" in name.lower() and "bov" in name.lower()
        and (found := re.search(r"(20\d{2})", name))
    }
    if not years:
        raise ValueError("no electric (BOV) year column found")
    # One sum per year column and raw state text; the years are literals from the header.
    per_state = body.groupBy(_cell(state).alias("State")).agg(*[
        total(clean_num(_cell(name), variant.number_markers)).alias(f"cell{i}")
        for i, name in enumerate(years)
    ])
    slots = {f"cell{i}": F.lit(year) for i, year in enumerate(years.values())}
    long = melt_labelled(per_state, ["State"], slots, "Year", "Value")
    name = state_name(F.col("State"), variant.state_style).alias("State")
    return long.groupBy(name, "Year").agg(
        total(F.col("Value")).alias("Reference_EV_Registrations")
    )


def _cell(name: str) -> Column:
    return F.col(f"`{name}`")
