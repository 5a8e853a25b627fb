"""Queries for aggregates over series, change windows and calendar filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from uptake.operators import forecast, ranking, rollups, windows
from uptake.plans import reports
from uptake.workloads import facts
from uptake.workloads.facts import END_YEAR, MONTHLY, REG, START_YEAR, STATE_EV, r4
from uptake.workloads.registry import query, rounded

EV = "EV_Registrations"


# ---- aggregates ---------------------------------------------------------------------------

@query("""
WITH m AS (SELECT year(o_orderdate) AS y, count(DISTINCT month(o_orderdate)) AS n
           FROM orders GROUP BY 1)
SELECT CAST(coalesce(max(y) FILTER (n >= 12), max(y)) AS INTEGER) AS Latest_Complete_Year FROM m""")
def latest_complete_year(spark, sf):
    return rollups.latest_complete_year(facts.table(spark, sf, "orders"), "o_orderdate")


@query(f"""
WITH {STATE_EV} SELECT State, count(*) FILTER (EV_Registrations > 1) AS Busy_Months,
  count(*) FILTER (EV_Registrations > 0) AS Nonzero_EV_Months FROM state_ev GROUP BY State""")
def nonzero_months(spark, sf):
    return facts.state_ev(spark, sf).groupBy("State").agg(
        rollups.positive_count(F.col(EV) - 1).alias("Busy_Months"),
        rollups.positive_count(F.col(EV)).alias("Nonzero_EV_Months"),
    )


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS Year FROM orders")
def distinct_years(spark, sf):
    orders = facts.table(spark, sf, "orders").select(F.year("o_orderdate").alias("Year"))
    return rollups.distinct_values(orders, "Year").orderBy("Year")


@query("SELECT o_orderpriority, count(*) AS Count FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return rollups.value_counts(facts.table(spark, sf, "orders"), "o_orderpriority")


@query(f"""
WITH {REG} SELECT count(DISTINCT State) AS States, count(DISTINCT Date) AS Months,
  count(DISTINCT State) FILTER (Is_EV) AS EV_States FROM reg""")
def distinct_count(spark, sf):
    return facts.registrations(spark, sf).agg(
        F.countDistinct("State").alias("States"), F.countDistinct("Date").alias("Months"),
        F.countDistinct(F.when(F.col("Is_EV"), F.col("State"))).alias("EV_States"),
    )


@query("""
SELECT l_returnflag, CAST(min(l_shipdate) AS DATE) AS First_Date,
       CAST(max(l_shipdate) AS DATE) AS Last_Date,
       CAST(min(l_shipdate) FILTER (l_quantity > 49) AS DATE) AS First_Large
FROM lineitem GROUP BY 1""")
def min_max_dates(spark, sf):
    lines = facts.table(spark, sf, "lineitem").withColumn("Date", F.to_date("l_shipdate"))
    return lines.groupBy("l_returnflag").agg(
        F.min("Date").alias("First_Date"), F.max("Date").alias("Last_Date"),
        F.min(F.when(F.col("l_quantity") > 49, F.col("Date"))).alias("First_Large"),
    )


@query(f"""
WITH {STATE_EV}, a AS (SELECT State, Year, sum(EV_Registrations) AS v FROM state_ev GROUP BY ALL)
SELECT State, arg_min(v, Year) AS First_Value, arg_max(v, Year) AS Last_Value,
       min(Year) AS First_Year, max(Year) AS Last_Year FROM a WHERE v > 0 GROUP BY State""")
def first_last_positive(spark, sf):
    annual = reports.state_annual(facts.state_ev(spark, sf)).where(F.col(EV) > 0)
    return annual.groupBy("State").agg(
        F.min_by(EV, "Year").alias("First_Value"), F.max_by(EV, "Year").alias("Last_Value"),
        F.min("Year").alias("First_Year"), F.max("Year").alias("Last_Year"),
    )


@query("""
SELECT coalesce(sum(l_quantity) FILTER (year(l_shipdate) = 1998), 0) AS In_1998,
       coalesce(sum(l_quantity) FILTER (year(l_shipdate) = 2050), 0) AS In_2050 FROM lineitem""")
def point_lookup_sum(spark, sf):
    """A year without rows gives 0, not NULL."""
    year = F.year("l_shipdate")
    return facts.table(spark, sf, "lineitem").agg(
        rollups.total_where(year == 1998, F.col("l_quantity")).alias("In_1998"),
        rollups.total_where(year == 2050, F.col("l_quantity")).alias("In_2050"),
    )


# ---- change -------------------------------------------------------------------------------

_SHIPPED = """shipped AS (
  SELECT Date, EV_Registrations FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS Date,
           CAST(count(*) AS DOUBLE) AS EV_Registrations FROM lineitem GROUP BY 1))"""


def _shipped(spark, sf):
    return facts.table(spark, sf, "lineitem").groupBy(
        facts.month_of("l_shipdate").alias("Date")
    ).agg(F.count("*").cast("double").alias(EV))


@query(f"""
WITH {_SHIPPED}, b AS (
  SELECT *, lag(EV_Registrations, 12) OVER (ORDER BY Date) AS p FROM shipped)
SELECT Date, EV_Registrations, {r4('(EV_Registrations - p) / nullif(p, 0) * 100')} AS YoY_Growth_Pct
FROM b WHERE p <> 0""")
def yoy_monthly_rows(spark, sf):
    """Against the twelfth row before, rows without one dropped."""
    return rounded(reports.monthly_growth(_shipped(spark, sf), only_known=True))


@query(f"""
WITH {STATE_EV}, b AS (
  SELECT State, Date, EV_Registrations,
         lag(EV_Registrations, 12) OVER (PARTITION BY State ORDER BY Date) AS p FROM state_ev)
SELECT State, Date, EV_Registrations,
       {r4('(EV_Registrations - p) / nullif(p, 0) * 100')} AS YoY_Growth_Pct FROM b""")
def yoy_state_rows(spark, sf):
    """Per state; the series have gaps, so the twelfth row before is not always a year before."""
    ev = facts.state_ev(spark, sf).select("State", "Date", EV)
    return rounded(reports.monthly_growth(ev, ["State"]))


@query(f"""
WITH {STATE_EV}
SELECT a.State, a.Date, a.EV_Registrations,
  {r4('(a.EV_Registrations - b.EV_Registrations) / nullif(b.EV_Registrations, 0) * 100')}
    AS YoY_Growth_Pct
FROM state_ev a LEFT JOIN state_ev b
  ON a.State = b.State AND b.Date = a.Date - INTERVAL 1 YEAR""")
def yoy_monthly_calendar(spark, sf):
    """Against the same month a year before."""
    ev = facts.state_ev(spark, sf).select("State", "Date", EV)
    return rounded(windows.change_by_calendar(ev, EV, "YoY_Growth_Pct", "Date", 12, ["State"]))


@query(f"""
WITH {STATE_EV}, a AS (SELECT State, Year, sum(EV_Registrations) AS v FROM state_ev GROUP BY ALL),
b AS (SELECT *, lag(v) OVER (PARTITION BY State ORDER BY Year) AS p FROM a)
SELECT State, Year, v AS EV_Registrations, {r4('(v - p) / nullif(p, 0) * 100')} AS Change_Percent
FROM b""")
def pct_change_1(spark, sf):
    annual = reports.state_annual(facts.state_ev(spark, sf))
    return rounded(windows.change_by_row(annual, EV, "Change_Percent", "Year", 1, ["State"]))


# ---- calendar and tails -------------------------------------------------------------------

_CALENDAR = f"""{STATE_EV}, span AS (
    SELECT State, min(Date) AS lo, max(Date) AS hi FROM state_ev WHERE {{0}} GROUP BY State),
  cal AS (SELECT State, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS Date
          FROM span),
  dense AS (SELECT State, Date, coalesce(EV_Registrations, 0) AS EV_Registrations
            FROM cal LEFT JOIN (SELECT * FROM state_ev WHERE {{1}}) USING (State, Date))"""


@query(f"""
WITH {_CALENDAR.format('true', 'true')} SELECT State, Date, EV_Registrations FROM dense""")
def densify_calendar(spark, sf):
    return forecast.densify(facts.state_ev(spark, sf), ["State"])


def _late_start(spark, sf):
    """The first two years of every series set to 0, as before a launch."""
    ev = facts.state_ev(spark, sf)
    started = F.col("Year") >= START_YEAR + 2
    return ev.withColumn(EV, F.when(started, F.col(EV)).otherwise(0.0))


@query(f"""
WITH {_CALENDAR.format(f'Year >= {START_YEAR + 2}', 'true')}
SELECT State, Date, EV_Registrations FROM dense""")
def trim_leading_zeros(spark, sf):
    return forecast.densify(_late_start(spark, sf), ["State"], trim=True)


@query(f"""
WITH {_CALENDAR.format('true', 'true')}, r AS (
  SELECT *, row_number() OVER (PARTITION BY State ORDER BY Date DESC) AS k FROM dense)
SELECT State, {r4('avg(EV_Registrations)')} AS Tail_Mean,
       {r4('stddev_pop(EV_Registrations)')} AS Tail_Std FROM r WHERE k <= 6 GROUP BY State""")
def tail_mean_std(spark, sf):
    dense = forecast.densify(facts.state_ev(spark, sf), ["State"])
    return rounded(windows.tail_statistics(dense, EV, "Date", 6, ["State"]))


@query(f"""
WITH {STATE_EV}, r AS (
  SELECT *, row_number() OVER (PARTITION BY State ORDER BY Date DESC) AS k FROM state_ev)
SELECT State, Date, EV_Registrations FROM r WHERE k <= 3""")
def last_rows_per_state(spark, sf):
    ev = facts.state_ev(spark, sf).select("State", "Date", EV)
    return windows.last_rows(ev, "Date", 3, ["State"])


@query(f"""
WITH {MONTHLY} SELECT Date, EV_Registrations FROM monthly WHERE Year = {END_YEAR}
ORDER BY EV_Registrations DESC, Date LIMIT 1""")
def best_month(spark, sf):
    monthly = facts.monthly_total(spark, sf).where(F.col("Year") == END_YEAR)
    return ranking.arg_max(monthly, EV, "Date", ["Date", EV])
