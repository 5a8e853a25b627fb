"""Queries for the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from uptake.operators import forecast as fc
from uptake.operators import matching, rollups
from uptake.operators.windows import series_window
from uptake.plans import reports
from uptake.workloads import facts
from uptake.workloads.facts import END_YEAR, HORIZON, REG, START_YEAR, STATE_EV
from uptake.workloads.forecasts import _sql
from uptake.workloads.registry import query, rounded

def _two_years(spark, sf):
    ev = facts.registrations(spark, sf).where("Is_EV").withColumn("Year", F.year("Date"))
    return ev.where(F.col("Year").isin(START_YEAR, END_YEAR))


@query(f"""
WITH {REG}, t AS (SELECT State, Category, Date, sum(Registrations) AS Total_Registrations FROM reg
                  GROUP BY ALL),
  e AS (SELECT State, Category, Date, sum(Registrations) AS EV_Registrations FROM reg WHERE Is_EV
        GROUP BY ALL)
SELECT State, Category, Date, Total_Registrations, coalesce(EV_Registrations, 0) AS EV_Registrations
FROM t LEFT JOIN e USING (State, Category, Date)""")
def join_left_fill(spark, sf):
    """Totals with the electric part, 0 where there is none."""
    reg = facts.registrations(spark, sf)
    return rollups.sums_where(
        reg, ["State", "Category", "Date"], "Registrations",
        Total_Registrations=F.lit(True), EV_Registrations=F.col("Is_EV"),
    )


@query(f"""
WITH {REG}, s AS (SELECT State, Category, sum(Registrations) AS a FROM reg
                  WHERE Is_EV AND year(Date) = {START_YEAR} GROUP BY ALL),
  e AS (SELECT State, Category, sum(Registrations) AS b FROM reg
        WHERE Is_EV AND year(Date) = {END_YEAR} GROUP BY ALL)
SELECT State, Category, coalesce(a, 0) AS At_Start, coalesce(b, 0) AS At_End
FROM s FULL JOIN e USING (State, Category)""")
def join_full_fill(spark, sf):
    """Two years side by side, whichever exists."""
    return rollups.sums_where(
        _two_years(spark, sf), ["State", "Category"], "Registrations",
        At_Start=F.col("Year") == START_YEAR, At_End=F.col("Year") == END_YEAR,
    )


@query(f"""
WITH {REG}, s AS (SELECT State, Category, sum(Registrations) AS a FROM reg
                  WHERE Is_EV AND year(Date) = {START_YEAR} GROUP BY ALL),
  e AS (SELECT State, Category, sum(Registrations) AS b FROM reg
        WHERE Is_EV AND year(Date) = {END_YEAR} GROUP BY ALL)
SELECT State, Category, a AS Registrations_Start, b AS Registrations_End
FROM s JOIN e USING (State, Category)""")
def join_inner_suffixes(spark, sf):
    """Two years side by side, only where both exist."""
    years = {"Registrations_Start": START_YEAR, "Registrations_End": END_YEAR}
    return rollups.sums_where(
        _two_years(spark, sf), ["State", "Category"], "Registrations", needed=tuple(years),
        **{name: F.col("Year") == year for name, year in years.items()},
    )


# ---- the joins on frames from different tables: customers and suppliers of each nation ----------

def _buyers(spark, sf):
    customers = facts.table(spark, sf, "customer")
    return customers.groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("Amount"))


def _sellers(spark, sf):
    """Suppliers with a low balance, so that some nations have none."""
    suppliers = facts.table(spark, sf, "supplier").where("s_acctbal < 1000")
    return suppliers.groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("Amount"))


_SIDES = """b AS (SELECT c_nationkey AS k, sum(c_acctbal) AS x FROM customer GROUP BY 1),
  s AS (SELECT s_nationkey AS k, sum(s_acctbal) AS y FROM supplier WHERE s_acctbal < 1000 GROUP BY 1)"""


@query(f"""
WITH {_SIDES} SELECT k, {facts.r4('x')} AS Amount, {facts.r4('coalesce(y, 0)')} AS Sold FROM b LEFT JOIN s USING (k)""")
def join_left_fill_tables(spark, sf):
    sellers = _sellers(spark, sf).withColumnRenamed("Amount", "Sold")
    return rounded(matching.left_fill(_buyers(spark, sf), sellers, ["k"], {"Sold": 0.0}))


@query(f"""
WITH {_SIDES} SELECT k, {facts.r4('coalesce(x, 0)')} AS Bought, {facts.r4('coalesce(y, 0)')} AS Sold
FROM b FULL JOIN s USING (k)""")
def join_full_fill_tables(spark, sf):
    return rounded(matching.merge_sums(
        ["k"], Bought=(_buyers(spark, sf), "Amount"), Sold=(_sellers(spark, sf), "Amount")))


@query(f"""
WITH {_SIDES} SELECT k, {facts.r4('x')} AS Amount_Bought, {facts.r4('y')} AS Amount_Sold FROM b JOIN s USING (k)""")
def join_inner_suffixes_tables(spark, sf):
    names = ("Amount_Bought", "Amount_Sold")
    return rounded(matching.inner_pair(_buyers(spark, sf), _sellers(spark, sf), ["k"], "Amount", names))


@query(f"""
WITH {_sql(STATE_EV, 'state_ev', ('State',))},
  ahead AS (SELECT State, round(sum(Predicted), 4) + 0.0 AS Predicted FROM raw
            WHERE year(Date) = {HORIZON} GROUP BY 1),
  base_year AS (SELECT State, sum(EV_Registrations) AS Actual FROM state_ev
                WHERE Year = {END_YEAR} GROUP BY 1)
SELECT * FROM ahead LEFT JOIN base_year USING (State)
  LEFT JOIN (SELECT State, Forecast_Method, Forecast_Confidence FROM met) USING (State)""")
def join_chained_lookups(spark, sf):
    """Forecast, base year and metrics of every state, from one scored frame."""
    scored = fc.score(facts.ev_rows(spark, sf), ["State"], end=HORIZON)
    outlook = reports.state_outlook(scored, HORIZON, END_YEAR)
    return rounded(outlook.select(
        "State", F.col("Predicted_EV_Registrations").alias("Predicted"),
        F.col(f"Actual_EV_Registrations_{END_YEAR}").alias("Actual"), "Forecast_Method", "Forecast_Confidence",
    ))


@query(f"""
WITH {STATE_EV} SELECT State, Date,
  CAST(date_diff('month', min(Date) OVER (PARTITION BY State), Date) AS INTEGER) AS Step
FROM state_ev""")
def time_index(spark, sf):
    """Months since the first row of the state, by calendar arithmetic."""
    ev = facts.state_ev(spark, sf)
    first = F.min("Date").over(series_window(["State"]))
    months = F.months_between("Date", first).cast("int")
    return ev.select("State", "Date", months.alias("Step"))
