"""Queries that compare and adjust two sources: order totals against their line items.

The monthly file is the order value by month, the reference the line item value by year, both per
nation.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from uptake.functions.numeric import total
from uptake.operators import forecast as fc
from uptake.operators import reconcile
from uptake.plans.reports import predicted_by_year
from uptake.workloads import facts
from uptake.workloads.facts import HORIZON, r4
from uptake.workloads.forecasts import _sql
from uptake.workloads.registry import query, rounded

THRESHOLD_ABS, THRESHOLD_PCT = 1000, 25


def monthly_values(spark, sf):
    """State, Date, Year, Month, EV_Registrations and the reference's part of the month.

    Order value and line item value in whole units, both by the order's month. Line items are summed
    per order before the join, so each table is read once and an order meets one row.
    """
    lines = facts.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round("l_extendedprice")).alias(reconcile.REFERENCE)
    )
    orders = facts.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), facts.month_of("o_orderdate").alias("Date"),
        F.round("o_totalprice").alias("EV_Registrations"),
    )
    valued = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    measures = ["EV_Registrations", reconcile.REFERENCE]
    placed = facts.by_nation(spark, sf, valued, ["Date"], measures)
    return placed.groupBy("State", "Date").agg(
        *[total(F.col(name)).alias(name) for name in measures]
    ).withColumns({"Year": F.year("Date"), "Month": F.month("Date")})


def annual_values(spark, sf):
    """Both measures by state and year."""
    return monthly_values(spark, sf).groupBy(*reconcile.KEYS).agg(
        total(F.col(reconcile.REFERENCE)).alias(reconcile.REFERENCE),
        total(F.col("EV_Registrations")).alias(reconcile.MONTHLY),
    )


_SOURCES = """monthly AS (
  SELECT n_name AS State, CAST(date_trunc('month', o_orderdate) AS DATE) AS Date,
         CAST(any_value(year(o_orderdate)) AS INTEGER) AS Year,
         CAST(any_value(month(o_orderdate)) AS INTEGER) AS Month,
         sum(round(o_totalprice)) AS EV_Registrations
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2),
reference AS (
  SELECT n_name AS State, CAST(year(o_orderdate) AS INTEGER) AS Year,
         sum(round(l_extendedprice)) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
m AS (SELECT State, Year, sum(EV_Registrations) AS v FROM monthly GROUP BY ALL),
both_sides AS (SELECT State, Year, coalesce(r, 0) AS r, coalesce(v, 0) AS v
               FROM reference FULL JOIN m USING (State, Year)),
paired AS (SELECT State, Year, r AS Reference_EV_Registrations,
                  v AS Monthly_File_EV_Registrations, v - r AS Difference,
                  (v - r) / nullif(r, 0) * 100 AS pct FROM both_sides),
flagged AS (SELECT *, coalesce(abs(Difference) > {abs} AND abs(pct) > {pct}, false)
                      AND Reference_EV_Registrations > 0 AS review FROM paired)""".format(
    abs=THRESHOLD_ABS, pct=THRESHOLD_PCT
)


@query(f"""
WITH {_SOURCES} SELECT * EXCLUDE (pct, review), {r4('pct')} AS Difference_Percent_vs_Reference,
  review AS Needs_Review FROM flagged""")
def reconcile_compare(spark, sf):
    return rounded(reconcile.review(annual_values(spark, sf)))


_FACTORS = f"""{_SOURCES}, factors AS (
  SELECT * EXCLUDE (review), review AND Monthly_File_EV_Registrations > 0 AS used,
    CASE WHEN review AND Monthly_File_EV_Registrations > 0
         THEN Reference_EV_Registrations / Monthly_File_EV_Registrations ELSE 1.0 END AS factor
  FROM flagged)"""


@query(f"""
WITH {_FACTORS} SELECT * EXCLUDE (pct, used, factor),
  {r4('pct')} AS Difference_Percent_vs_Reference, used AS Use_Reference_Adjustment,
  {r4('factor')} AS Adjustment_Factor FROM factors""")
def reconcile_factors(spark, sf):
    return rounded(reconcile.factors(annual_values(spark, sf)))


_ADJUSTED = f"""{_FACTORS}, adjusted AS (
  SELECT State, Date, monthly.Year, Month, EV_Registrations,
         EV_Registrations AS EV_Registrations_Original, coalesce(factor, 1.0) AS factor,
         coalesce(used, false) AS Use_Reference_Adjustment,
         EV_Registrations * coalesce(factor, 1.0) AS adjusted
  FROM monthly LEFT JOIN factors USING (State, Year))"""


@query(f"""
WITH {_ADJUSTED} SELECT * EXCLUDE (factor, adjusted), {r4('factor')} AS Adjustment_Factor,
  {r4('adjusted')} AS EV_Registrations_Adjusted FROM adjusted""")
def reconcile_adjust(spark, sf):
    return rounded(reconcile.adjust(monthly_values(spark, sf), reconcile.REFERENCE))


_SPARSE = f"""{_FACTORS}, adjusted AS (
  SELECT State, Date, round(EV_Registrations * coalesce(factor, 1.0) / 1000) AS adjusted
  FROM monthly LEFT JOIN factors USING (State, Year))"""


@query(f"""
WITH {_sql(_SPARSE, 'adjusted', ('State',), value='adjusted')} SELECT State, Year,
  {r4('sum(raw_v)')} AS Predicted_EV_Registrations
FROM (SELECT State, CAST(year(Date) AS INTEGER) AS Year, Predicted AS raw_v FROM raw)
GROUP BY ALL""")
def reconcile_forecast(spark, sf):
    """Reference, adjustment and forecast of the adjusted values wired together, in thousands."""
    adjusted = reconcile.adjust(monthly_values(spark, sf), reconcile.REFERENCE)
    thousands = adjusted.withColumn(
        "EV_Registrations_Adjusted", F.round(F.col("EV_Registrations_Adjusted") / 1000)
    )
    scored = fc.score(thousands, ["State"], "EV_Registrations_Adjusted", end=HORIZON)
    return rounded(predicted_by_year(scored, ["State"]))
