"""Queries for growth, penetration, rankings, wide tables and sheet layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from uptake.operators import adoption, ranking, reshape, rollups
from uptake.plans import preparation, reports, sheets
from uptake.plans.variants import BATCH, DASHBOARD
from uptake.sources.readers import ROW_NO
from uptake.workloads import facts
from uptake.workloads.facts import (
    CATEGORY_EV, END_YEAR, REG, START_YEAR, STATE_EV, YEARLY, YEARS, r4,
)
from uptake.workloads.registry import query, rounded

SPAN = END_YEAR - START_YEAR


# ---- growth -------------------------------------------------------------------------------

@query(f"""
WITH {YEARLY}, ends AS (
  SELECT coalesce(sum(Registrations) FILTER (Year = {START_YEAR}), 0) AS s,
         coalesce(sum(Registrations) FILTER (Year = {END_YEAR}), 0) AS e
  FROM yearly WHERE Is_EV AND Category = 'All Vehicles')
SELECT {START_YEAR} AS Start_Year, {END_YEAR} AS End_Year, s AS Start_EV_Registrations,
       e AS End_EV_Registrations,
       {r4('CASE WHEN s > 0 THEN (e - s) / s * 100 END')} AS Overall_Growth_Percent,
       {r4(f'CASE WHEN s > 0 THEN (pow(e / s, 1.0 / {SPAN}) - 1) * 100 END')} AS CAGR_Percent
FROM ends""")
def cagr_national(spark, sf):
    return rounded(adoption.national_growth(facts.yearly(spark, sf), START_YEAR, END_YEAR))


@query(f"""
WITH {YEARLY}, t AS (
  SELECT sum(Registrations) FILTER (Year = {START_YEAR}) AS s,
         sum(Registrations) FILTER (Year = {END_YEAR}) AS e
  FROM yearly WHERE Is_EV AND Category = 'All Vehicles')
SELECT e AS Latest, {r4('(e - s) / s * 100')} AS Overall_Growth_Percent FROM t""")
def overall_growth(spark, sf):
    table = adoption.national_growth(facts.yearly(spark, sf), START_YEAR, END_YEAR)
    return rounded(table.select(
        F.col("End_EV_Registrations").alias("Latest"), "Overall_Growth_Percent"
    ))


# 'none' exists only at the start, 'late' only at the end: they tell the two joins apart.
def _uneven(spark, sf):
    yearly = facts.yearly(spark, sf).withColumn(
        "Category",
        F.when((F.col("Category") == "5-LOW") & (F.col("Year") < END_YEAR), "none")
        .when((F.col("Category") == "5-LOW") & (F.col("Year") >= END_YEAR), "late")
        .otherwise(F.col("Category")),
    )
    return yearly


_UNEVEN_SQL = f"""{YEARLY}, uneven AS (
  SELECT CASE WHEN Category = '5-LOW' AND Year < {END_YEAR} THEN 'none'
              WHEN Category = '5-LOW' THEN 'late' ELSE Category END AS Category,
         Year, Registrations FROM yearly WHERE Is_EV AND Category <> 'All Vehicles'),
  s AS (SELECT Category, sum(Registrations) AS s FROM uneven WHERE Year = {START_YEAR} GROUP BY 1),
  e AS (SELECT Category, sum(Registrations) AS e FROM uneven WHERE Year = {END_YEAR} GROUP BY 1)"""
_CAGR_SQL = r4(f"CASE WHEN s > 0 THEN (pow(e / s, 1.0 / {SPAN}) - 1) * 100 END")


@query(f"""
WITH {_UNEVEN_SQL}, both_sides AS (
  SELECT Category, coalesce(s, 0) AS s, coalesce(e, 0) AS e FROM s FULL JOIN e USING (Category))
SELECT Category, s AS Start_EV_Registrations, e AS End_EV_Registrations,
       {_CAGR_SQL} AS CAGR_Percent FROM both_sides""")
def cagr_category_outer(spark, sf):
    return rounded(adoption.category_growth(_uneven(spark, sf), START_YEAR, END_YEAR))


@query(f"""
WITH {_UNEVEN_SQL}
SELECT Category, s AS Registrations_Start, e AS Registrations_End, {_CAGR_SQL} AS CAGR_Percent
FROM s JOIN e USING (Category)""")
def cagr_category_inner(spark, sf):
    names = ("Registrations_Start", "Registrations_End")
    return rounded(
        adoption.category_growth(_uneven(spark, sf), START_YEAR, END_YEAR, False, names)
    )


# ---- penetration --------------------------------------------------------------------------

_PENETRATION = f"""{YEARLY},
  totals AS (SELECT Category, Year, sum(Registrations) AS t FROM yearly
             WHERE lower(Fuel_Type) = 'total' GROUP BY ALL),
  evs AS (SELECT Category, Year, sum(Registrations) AS e FROM yearly WHERE Is_EV GROUP BY ALL),
  penetration AS (
    SELECT Category, Year, t AS Total_Registrations, coalesce(e, 0) AS EV_Registrations,
           {r4('coalesce(e, 0) / nullif(t, 0) * 100')} AS EV_Penetration_Percent
    FROM totals LEFT JOIN evs USING (Category, Year))"""


def _penetration(spark, sf):
    return adoption.penetration(facts.yearly(spark, sf))


@query(f"""
WITH {_PENETRATION} SELECT * FROM penetration
WHERE Category = 'All Vehicles' AND Year BETWEEN {START_YEAR} AND {END_YEAR}""")
def penetration_national(spark, sf):
    return rounded(adoption.national_penetration(_penetration(spark, sf), START_YEAR, END_YEAR))


@query(f"WITH {_PENETRATION} SELECT * FROM penetration WHERE Category <> 'All Vehicles'")
def penetration_category(spark, sf):
    return rounded(adoption.category_penetration(_penetration(spark, sf)))


@query(f"""
WITH {_PENETRATION} SELECT * FROM penetration
WHERE Category = 'All Vehicles' AND Year = (SELECT max(Year) FROM penetration)""")
def penetration_latest_kpi(spark, sf):
    national = adoption.national_penetration(_penetration(spark, sf))
    return rounded(reports.penetration_kpi(national))


@query(f"""
WITH {_PENETRATION} SELECT * FROM penetration
WHERE Category <> 'All Vehicles' AND Year = {END_YEAR}""")
def penetration_year_rank(spark, sf):
    return rounded(adoption.category_penetration(_penetration(spark, sf), END_YEAR))


# ---- states and categories ----------------------------------------------------------------

@query(f"""
WITH {STATE_EV} SELECT State, Year, sum(EV_Registrations) AS EV_Registrations
FROM state_ev GROUP BY ALL""")
def state_annual(spark, sf):
    return reports.state_annual(facts.state_ev(spark, sf))


@query(f"""
WITH {STATE_EV} SELECT State, Year, sum(EV_Registrations) AS EV_Registrations
FROM state_ev WHERE Year = {END_YEAR} GROUP BY ALL
ORDER BY EV_Registrations DESC, State LIMIT 10""")
def state_annual_top10(spark, sf):
    return reports.top_states(facts.state_ev(spark, sf), END_YEAR)


@query(f"""
WITH {STATE_EV} SELECT State, Year, sum(EV_Registrations) AS EV_Registrations
FROM state_ev WHERE State = 'NATION_7' GROUP BY ALL""")
def state_trend(spark, sf):
    return reports.state_trend(facts.state_ev(spark, sf), "NATION_7")


@query(f"""
WITH {STATE_EV} SELECT Year, sum(EV_Registrations) AS EV_Registrations FROM state_ev GROUP BY 1""")
def annual_total(spark, sf):
    return reports.annual_total(reports.state_annual(facts.state_ev(spark, sf)))


@query(f"""
WITH {STATE_EV} SELECT DISTINCT State FROM state_ev""")
def distinct_states(spark, sf):
    return rollups.distinct_values(facts.state_ev(spark, sf), "State")


@query(f"""
WITH {STATE_EV} SELECT coalesce(max(Year) FILTER (Year = 2023), max(Year)) AS Default_Year
FROM state_ev""")
def default_state_year(spark, sf):
    return rollups.default_year(facts.state_ev(spark, sf), 2023)


@query(f"""
WITH {STATE_EV} SELECT count(*) AS Rows, 5 AS Columns FROM state_ev""")
def frame_shape(spark, sf):
    return rollups.shape(facts.state_ev(spark, sf))


@query(f"""
WITH {STATE_EV}, h AS (SELECT * FROM state_ev ORDER BY State, Date LIMIT 5),
     t AS (SELECT * FROM state_ev ORDER BY State DESC, Date DESC LIMIT 5)
SELECT *, 'head' AS Part FROM h UNION ALL SELECT *, 'tail' FROM t""")
def head_tail_preview(spark, sf):
    ev = facts.state_ev(spark, sf)
    order = ["State", "Date"]
    return reshape.stack(
        ranking.head(ev, order, 5).withColumn("Part", F.lit("head")),
        ranking.tail(ev, order, 5).withColumn("Part", F.lit("tail")),
    )


_CATEGORY_YEARLY = f"""{YEARLY}, category_yearly AS (
  SELECT Category, Year, sum(Registrations) AS EV_Registrations FROM yearly
  WHERE Is_EV AND Category <> 'All Vehicles' AND Year BETWEEN {START_YEAR} AND {END_YEAR}
  GROUP BY ALL)"""


@query(f"WITH {_CATEGORY_YEARLY} SELECT * FROM category_yearly")
def category_yearly(spark, sf):
    return reports.category_yearly(facts.yearly(spark, sf), START_YEAR, END_YEAR)


@query(f"""
WITH {_CATEGORY_YEARLY} SELECT Category, sum(EV_Registrations) AS EV_Registrations
FROM category_yearly GROUP BY 1""")
def category_rank(spark, sf):
    return reports.category_ranking(category_yearly(spark, sf))


@query(f"""
WITH {_CATEGORY_YEARLY} SELECT Category, sum(EV_Registrations) AS EV_Registrations
FROM category_yearly GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def category_top(spark, sf):
    ranked = reports.category_ranking(category_yearly(spark, sf))
    return ranking.arg_max(ranked, "EV_Registrations", "Category")


# ---- wide tables --------------------------------------------------------------------------

@query(f"""
WITH {CATEGORY_EV} SELECT Year,
  {", ".join(f"sum(EV_Registrations) FILTER (Month = {i + 1}) AS {m}" for i, m in enumerate(
      ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")))}
FROM category_ev GROUP BY Year""")
def pivot_seasonality(spark, sf):
    return reshape.seasonality(facts.category_ev(spark, sf), "EV_Registrations")


_LONG_MONTHS = " UNION ALL ".join(
    f"""SELECT Date, '{label}' AS Category,
        CAST(count(*) FILTER (o_orderpriority = '{priority}') AS DOUBLE) AS EV_Registrations
        FROM m GROUP BY Date"""
    for label, priority in zip(
        ("2W", "3W", "Cars", "Goods Vehicles", "Buses"), facts.WIDE.values()
    )
)
_M = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Date, o_orderpriority
       FROM orders)"""


@query(f"""
WITH {_M}, long AS ({_LONG_MONTHS})
SELECT Date, Category, EV_Registrations, CAST(year(Date) AS INTEGER) AS Year,
       CAST(month(Date) AS INTEGER) AS Month, strftime(Date, '%b') AS Month_Name FROM long""")
def monthly_category_prep(spark, sf):
    return preparation.monthly_categories(facts.wide_monthly(spark, sf)).categories


@query("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Date,
       CAST(count(*) AS DOUBLE) AS EV_Registrations,
       CAST(any_value(year(o_orderdate)) AS INTEGER) AS Year,
       CAST(any_value(month(o_orderdate)) AS INTEGER) AS Month,
       any_value(strftime(o_orderdate, '%b')) AS Month_Name
FROM orders GROUP BY 1""")
def monthly_total_prep(spark, sf):
    return preparation.monthly_categories(facts.wide_monthly(spark, sf)).totals


@query(f"""
WITH {_M}
SELECT Date, CAST(count(*) AS DOUBLE) AS EV_Registrations, CAST(year(Date) AS INTEGER) AS Year,
       CAST(month(Date) AS INTEGER) AS Month, strftime(Date, '%b') AS Month_Name
FROM m WHERE o_orderpriority IN ({", ".join(f"'{p}'" for p in facts.WIDE.values())})
GROUP BY Date""")
def monthly_total_from_parts(spark, sf):
    """Without a total column the total is the sum of the categories."""
    wide = facts.wide_monthly(spark, sf).drop("Total Registration")
    return preparation.monthly_categories(wide, DASHBOARD).totals


@query("""
WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, o_orderstatus, o_orderpriority
           FROM orders)
SELECT Year, count(*) FILTER (o_orderpriority = '1-URGENT') AS Urgent,
       count(*) FILTER (o_orderpriority = '5-LOW') AS Low, count(*) AS Total,
       CAST(count(*) - count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) AS DOUBLE) AS Gap
FROM p GROUP BY Year""")
def total_vs_parts_check(spark, sf):
    """Years whose total is more than the sum of two of its parts."""
    orders = facts.table(spark, sf, "orders")
    wide = orders.groupBy(F.year("o_orderdate").alias("Year")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("Urgent"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("Low"),
        F.count("*").alias("Total"),
    )
    return reports.total_mismatches(wide, ["Urgent", "Low"], "Total")


# ---- state tables -------------------------------------------------------------------------

def _state_table(spark, sf):
    """The registrations as a dirty state table: text dates, odd labels, formatted numbers."""
    reg = facts.registrations(spark, sf)
    bad_date = (F.col("Category") == "5-LOW") & (F.col("Fuel_Type") == "DIESEL")
    return reg.select(
        F.when(bad_date, "not a date").otherwise(F.date_format("Date", "yyyy-MM-dd")).alias("date"),
        F.concat(F.lit("  "), F.lower("State"), F.lit(" & Isles ")).alias("state_name"),
        F.when(F.col("Is_EV"), " electric  (bov)").otherwise(F.col("Fuel_Type")).alias("fuel_type"),
        F.format_number("Registrations", 1).alias("registrations"),
    )


_STATE_KEYS = """'Nation' || State[7:] || ' And Isles' AS State, Date,
  CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month"""


@query(f"""
WITH {REG} SELECT {_STATE_KEYS}, sum(Registrations) AS EV_Registrations
FROM reg WHERE Is_EV GROUP BY ALL""")
def state_monthly_ev(spark, sf):
    return preparation.state_months(_state_table(spark, sf)).electric


@query(f"""
WITH {REG} SELECT {_STATE_KEYS}, sum(Registrations) AS Total_Registrations
FROM reg WHERE NOT (Category = '5-LOW' AND Fuel_Type = 'DIESEL') GROUP BY ALL""")
def state_monthly_total(spark, sf):
    return preparation.state_months(_state_table(spark, sf)).all_fuels


@query(f"""
WITH {REG}
SELECT {_STATE_KEYS}, Registrations, Is_EV, CASE WHEN Is_EV THEN 'Electric (Bov)' ELSE
  CASE Fuel_Type WHEN 'PETROL/CNG' THEN 'Petrol/Cng' WHEN 'STRONG HYBRID EV' THEN 'Strong Hybrid Ev'
       ELSE upper(Fuel_Type[1]) || lower(Fuel_Type[2:]) END END AS Fuel_Type
FROM reg WHERE NOT (Category = '5-LOW' AND Fuel_Type = 'DIESEL')""")
def state_rows_cleaned(spark, sf):
    return preparation.state_months(_state_table(spark, sf)).rows


# ---- sheets -------------------------------------------------------------------------------

def _sheet(spark, sf):
    """Yearly sheet: totals in rows 0-3, blank rows, category rows from 7, a source footer."""
    yearly = facts.yearly(spark, sf).withColumn(
        "text", F.concat(F.lit(" "), F.format_number("Registrations", 0))
    )
    wide = yearly.groupBy("Category", "Fuel_Type").agg(*[
        F.max(F.when(F.col("Year") == year, F.col("text"))).alias(f"FY{year}") for year in YEARS
    ])
    years = [f"FY{year}" for year in YEARS]
    place = F.lit(None).cast("long")
    for row, fuel in enumerate(("Total", "ELECTRIC(BOV)", "PETROL", "DIESEL")):
        place = F.when(F.col("Fuel_Type") == fuel, F.lit(row).cast("long")).otherwise(place)

    def entry(label, row):
        return F.struct(label.alias("a"), row.cast("long").alias(ROW_NO))

    # Each label pair becomes its sheet rows in place, so the yearly fact is computed once.
    national = F.col("Category") == "All Vehicles"
    entries = F.array(
        F.when(national & (place >= 0), entry(F.lit("India"), place)),
        F.when(national & (place <= 1), entry(F.lit("Gap"), place + 4)),
        F.when(national & (place == 0), entry(F.lit("Source: registers"), F.lit(1 << 40))),
        F.when(~national, entry(F.col("Category"), F.monotonically_increasing_id() + 7)),
    )
    placed = wide.withColumn("e", F.explode(F.array_compact(entries)))
    return placed.select("e.a", F.col("Fuel_Type").alias("b"), *years, f"e.{ROW_NO}")


_SHEET_YEARS = "(SELECT unnest(range({}, {})) AS Year)".format(YEARS[0], YEARS[-1] + 1)


@query(f"""
WITH {YEARLY}, labels AS (
  SELECT DISTINCT Category, Fuel_Type FROM yearly
  WHERE Category <> 'All Vehicles'
     OR Fuel_Type IN ('Total', 'ELECTRIC(BOV)', 'PETROL', 'DIESEL')),
cells AS (SELECT Category, Fuel_Type, CAST(Year AS INTEGER) AS Year FROM labels, {_SHEET_YEARS})
SELECT upper(Category[1]) || CASE Category WHEN 'All Vehicles' THEN 'll Vehicles'
         WHEN '1-URGENT' THEN '-Urgent' WHEN '2-HIGH' THEN '-High' WHEN '3-MEDIUM' THEN '-Medium'
         WHEN '4-NOT SPECIFIED' THEN '-Not Specified' ELSE '-Low' END AS Category,
       CASE Fuel_Type WHEN 'ELECTRIC(BOV)' THEN 'Electric(Bov)' WHEN 'PETROL/CNG' THEN 'Petrol/Cng'
         WHEN 'STRONG HYBRID EV' THEN 'Strong Hybrid Ev'
         ELSE upper(Fuel_Type[1]) || lower(Fuel_Type[2:]) END AS Fuel_Type,
       'FY' || Year AS Financial_Year, Year, Fuel_Type = 'ELECTRIC(BOV)' AS Is_EV,
       coalesce(Registrations, 0) AS Registrations
FROM cells LEFT JOIN yearly USING (Category, Fuel_Type, Year)""")
def sheet_bands_to_long(spark, sf):
    return sheets.bands_to_long(_sheet(spark, sf), ("a", "b"))


@query(f"""
WITH {YEARLY}, labels AS (
  SELECT DISTINCT Category, Fuel_Type FROM yearly
  WHERE Category <> 'All Vehicles'
     OR Fuel_Type IN ('Total', 'ELECTRIC(BOV)', 'PETROL', 'DIESEL')
  UNION ALL SELECT 'Source: registers', 'Total'),
cells AS (SELECT Category, Fuel_Type, CAST(Year AS INTEGER) AS Year FROM labels, {_SHEET_YEARS})
SELECT Category, Fuel_Type, 'FY' || Year AS Financial_Year, Year,
       Fuel_Type = 'ELECTRIC(BOV)' AS Is_EV,
       CASE Category WHEN 'Source: registers' THEN
         (SELECT Registrations FROM yearly y WHERE y.Category = 'All Vehicles'
            AND y.Fuel_Type = 'Total' AND y.Year = cells.Year)
         ELSE coalesce(Registrations, 0) END AS Registrations
FROM cells LEFT JOIN yearly USING (Category, Fuel_Type, Year)""")
def sheet_bands_raw_labels(spark, sf):
    """The variant without footer filter, label rules and merging."""
    return sheets.bands_to_long(_sheet(spark, sf), ("a", "b"), BATCH)


def stacked_grid(spark, sf):
    """A reference table with a fuel row above the year row, one block of years per fuel.

    Only years 20xx count in such a table, so each year is written ten years later.
    """
    blocks = ("PETROL", "ELECTRIC(BOV)")
    slots = [(fuel, year) for fuel in blocks for year in YEARS]
    reg = facts.registrations(spark, sf).withColumn("Year", F.year("Date"))
    body = reg.groupBy("State").agg(*[
        F.format_number(
            F.sum(F.when(
                (F.col("Fuel_Type") == fuel) & (F.col("Year") == year), F.col("Registrations")
            )), 0,
        ).alias(f"c{i}") for i, (fuel, year) in enumerate(slots, start=1)
    ])
    cells = [f"c{i}" for i in range(len(slots) + 1)]
    body = body.withColumnRenamed("State", "c0").withColumn(ROW_NO, F.monotonically_increasing_id() + 5)
    fuel_row = [None] + [fuel if year == YEARS[0] else None for fuel, year in slots]
    year_row = ["State/UT"] + [str(year + 10) for _, year in slots]
    total_row = ["Grand Total"] + ["1" for _ in slots]
    schema = ", ".join(f"{c} string" for c in cells) + f", {ROW_NO} long"
    head = spark.createDataFrame(
        [("Electric registrations by region", *[None] * len(slots), 0), (*fuel_row, 1), (*year_row, 2),
         (*total_row, 3), (*[None] * (len(slots) + 1), 4)], schema,
    )
    return reshape.stack(head, body.select(*cells, ROW_NO))


@query(f"""
WITH {REG}, sums AS (
  SELECT State, CAST(year(Date) AS INTEGER) AS Year, sum(Registrations) AS v
  FROM reg WHERE Is_EV GROUP BY ALL),
states AS (SELECT DISTINCT State FROM reg)
SELECT 'Nation' || State[7:] AS State, CAST(y.Year + 10 AS INTEGER) AS Year,
       coalesce(v, 0) AS Reference_EV_Registrations
FROM (SELECT * FROM states, {_SHEET_YEARS}) y LEFT JOIN sums s USING (State, Year)""")
def two_row_header_long(spark, sf):
    return sheets.stacked_header_to_long(stacked_grid(spark, sf))
