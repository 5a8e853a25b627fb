"""Reports: what a reader of the analysis sees, each as one plan over prepared frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.functions import dates
from uptake.functions.numeric import pct_change, share_percent
from uptake.operators import forecast as fc
from uptake.operators import ranking
from uptake.operators.rollups import sum_by
from uptake.operators.windows import change_by_row
from uptake.plans.variants import DEFAULT, ForecastPolicy

EV = "EV_Registrations"
PREDICTED = "Predicted_EV_Registrations"


# ---- states -------------------------------------------------------------------------------

def state_annual(monthly: DataFrame) -> DataFrame:
    return sum_by(monthly, ["State", "Year"], EV)


def top_states(monthly: DataFrame, year: int, k: int = 10) -> DataFrame:
    """The k states with most electric registrations in a year."""
    one_year = monthly.where(F.col("Year") == year)
    return ranking.top_k(state_annual(one_year), EV, k, ["State"])


def state_trend(monthly: DataFrame, state: str) -> DataFrame:
    return state_annual(monthly.where(F.col("State") == state)).orderBy("Year")


def annual_total(monthly: DataFrame) -> DataFrame:
    """Sum over all states per year."""
    return sum_by(monthly, ["Year"], EV).orderBy("Year")


# ---- categories ---------------------------------------------------------------------------

def category_yearly(yearly: DataFrame, first: int, last: int) -> DataFrame:
    """Electric registrations per category and year within an inclusive range of years."""
    rows = yearly.where(
        F.col("Is_EV") & (F.col("Category") != "All Vehicles") & F.col("Year").between(first, last)
    )
    return sum_by(rows, ["Category", "Year"], "Registrations", EV)


def category_ranking(per_year: DataFrame) -> DataFrame:
    """Categories by their sum over all years, largest first."""
    sums = sum_by(per_year, ["Category"], EV)
    return sums.orderBy(*ranking.descending(EV), *ranking.ascending("Category"))


def penetration_kpi(national: DataFrame) -> DataFrame:
    """The row of the latest year of a national penetration table."""
    return ranking.latest_rows(national, "Year")


# ---- monthly ------------------------------------------------------------------------------

def monthly_growth(totals: DataFrame, keys=(), only_known: bool = False) -> DataFrame:
    """Change against the twelfth row before; ``only_known`` drops rows without one."""
    grown = change_by_row(totals, EV, "YoY_Growth_Pct", "Date", 12, keys)
    return grown.dropna(subset=["YoY_Growth_Pct"]) if only_known else grown


# ---- national and category forecast -------------------------------------------------------

def annual_outlook(
    scored: DataFrame, grain: str = "month", last_years: int | None = None
) -> DataFrame:
    """Predicted and actual sums per year of one scored series, with the predicted growth.

    Both sums come from the scored rows in one aggregate: they already carry every observed value.
    """
    year = F.year(dates.period_date(F.col("Period"), grain)).alias("Year")
    live = F.col("Step") >= 0
    annual = (
        scored.groupBy(year)
        .agg(
            F.sum(F.when(live, F.col("Predicted"))).alias(PREDICTED),
            F.sum(F.when(F.col("Observed"), F.col("Value"))).alias("Actual_EV_Registrations"),
            F.max(dates.period_date(F.col("Last"), grain)).alias("__last"),
        )
        .where(F.col(PREDICTED).isNotNull())
    )
    typed = annual.withColumn(
        "Data_Type",
        F.when(F.col("Year") <= F.year("__last"), F.lit("Actual")).otherwise("Forecast"),
    ).drop("__last")
    grown = change_by_row(typed, PREDICTED, "Forecast_YoY_Growth_Percent", "Year", 1)
    return ranking.tail(grown, ["Year"], last_years) if last_years else grown.orderBy("Year")


def predicted_by_year(scored: DataFrame, keys, grain: str = "month") -> DataFrame:
    """Predicted sum per key and year."""
    year = F.year(dates.period_date(F.col("Period"), grain)).alias("Year")
    return scored.where(F.col("Step") >= 0).groupBy(*keys, year).agg(
        F.sum("Predicted").alias(PREDICTED)
    )


def category_outlook(scored: DataFrame, year: int, key: str = "Category") -> DataFrame:
    """Predicted sum per category for one year, largest first."""
    in_year = F.floor(F.col("Period") / 12) == year
    rows = scored.where((F.col("Step") >= 0) & in_year).groupBy(key).agg(
        F.sum("Predicted").alias(PREDICTED)
    )
    return rows.select(F.lit(year).alias("Year"), key, PREDICTED).orderBy(
        *ranking.descending(PREDICTED), *ranking.ascending(key)
    )


def leading(outlook: DataFrame, key: str) -> DataFrame:
    """The key with the highest prediction."""
    return ranking.arg_max(outlook, PREDICTED, key, [key, PREDICTED])


# ---- state forecast -----------------------------------------------------------------------

def _per_state(scored, year, base_year, policy, key):
    """One aggregate by key over the scored rows: prediction, base value and metrics together.

    The rows already lie partitioned by key; separate frames would have to be joined.
    """
    period_year = F.floor(F.col("Period") / 12)
    seen_in_base = F.col("Observed") & (period_year == base_year)
    predicted_in_year = (F.col("Step") >= 0) & (period_year == year)
    rows = scored.groupBy(key).agg(
        F.sum(F.when(predicted_in_year, F.col("Predicted"))).alias(PREDICTED),
        F.sum(F.when(seen_in_base, F.col("Value"))).alias("__base"),
        F.max("Fit").alias("Model_Fit_Score"),
        F.max("Positive").alias("Nonzero_EV_Months"),
        F.max("Last").alias("__last"),
        F.bool_or("Modelled").alias("Modelled"),
    )
    tier = fc.confidence_tier(F.col("Model_Fit_Score"), F.col("Nonzero_EV_Months"), policy)
    return rows.withColumn("Forecast_Confidence", tier)


def state_outlook(
    scored: DataFrame, year: int, base_year: int,
    policy: ForecastPolicy = DEFAULT.forecast, key: str = "State",
) -> DataFrame:
    """Prediction of a year per state with growth against a base year, fit and confidence."""
    rows = _per_state(scored, year, base_year, policy, key)
    base = F.col("__base")
    last = dates.month_label(dates.period_date(F.col("__last"), "month"))
    return rows.where(F.col(PREDICTED).isNotNull()).select(
        key, F.lit(year).alias("Year"), PREDICTED,
        base.alias(f"Actual_EV_Registrations_{base_year}"),
        "Model_Fit_Score", "Nonzero_EV_Months", last.alias("Last_Actual_Month"),
        fc.method_name(policy).alias("Forecast_Method"), "Forecast_Confidence",
        pct_change(F.col(PREDICTED), base).alias(f"Growth_vs_{base_year}_Percent"),
    ).orderBy(*ranking.descending(PREDICTED), *ranking.ascending(key))


def outlook_kpis(
    scored: DataFrame, year: int, policy: ForecastPolicy = DEFAULT.forecast, key: str = "State"
) -> DataFrame:
    """One row: states forecast, states with high confidence, latest actual month of any state."""
    rows = _per_state(scored, year, year, policy, key)
    shown = F.col(PREDICTED).isNotNull()
    latest = dates.period_date(F.max("__last"), "month")
    return rows.agg(
        F.count_if(shown).alias("States_Forecasted"),
        F.count_if(shown & (F.col("Forecast_Confidence") == "High")).alias("High_Confidence_States"),
        dates.month_label(latest).alias("Latest_Actual_Month"),
    )


def combined_trend(
    scored: DataFrame, monthly: DataFrame, state: str | None = None, key: str = "State"
) -> DataFrame:
    """Actual rows above fitted and forecast rows.

    Predictions up to the last actual month of *all* states count as fitted. Each scored row turns
    into its one or two trend rows in place, so the series are computed once; the monthly frame
    only gives the last month (stage it first if it is not a stored table).
    """
    latest = monthly.agg(F.max("Date")).scalar()
    rows = scored if state is None else scored.where(F.col(key) == state)
    date = dates.period_date(F.col("Period"), "month")
    dated = rows.withColumn("Date", date).withColumn(
        "__kind", F.when(F.col("Date") <= latest, F.lit("Fitted")).otherwise("Forecast")
    )
    actual = F.when(
        F.col("Observed"),
        F.struct(F.lit("Actual").alias("Data_Type"), F.col("Value").alias(EV)),
    )
    predicted = F.when(
        F.col("Step") >= 0,
        F.struct(F.col("__kind").alias("Data_Type"), F.col("Predicted").alias(EV)),
    )
    points = F.explode(F.array_compact(F.array(actual, predicted)))
    return dated.select(key, "Date", points.alias("__p")).select(
        key, "Date", F.col(f"__p.{EV}").alias(EV), F.col("__p.Data_Type").alias("Data_Type")
    )


def end_year_summary(
    scored: DataFrame, year: int, policy: ForecastPolicy = DEFAULT.forecast, key: str = "State"
) -> DataFrame:
    """Prediction of a year with fit, history, method and confidence, largest first."""
    name = f"{PREDICTED}_{year}"
    outlook = state_outlook(scored, year, year, policy, key)
    return outlook.select(
        key, F.col(PREDICTED).alias(name), "Model_Fit_Score", "Nonzero_EV_Months",
        "Forecast_Method", "Forecast_Confidence",
    ).orderBy(*ranking.descending(name), *ranking.ascending(key))


def diagnostics(metrics: DataFrame, key: str) -> DataFrame:
    """Metrics by confidence (if graded) and fit, best fit first, missing fit last."""
    graded = "Forecast_Confidence" in metrics.columns
    order = ranking.ascending("Forecast_Confidence") if graded else []
    return metrics.orderBy(
        *order, *ranking.descending("Model_Fit_Score"), *ranking.ascending(key)
    )


# ---- data quality -------------------------------------------------------------------------

def total_mismatches(table: DataFrame, parts, whole: str, tolerance: float = 0.0) -> DataFrame:
    """Rows of a wide table whose total is not the sum of its parts, with the gap."""
    summed = sum((F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
    gap = F.coalesce(F.col(whole).cast("double"), F.lit(0.0)) - summed
    return table.withColumn("Gap", gap).where(F.abs("Gap") > tolerance)


def share_table(table: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """Share per key recomputed from its two counts; a missing count gives a NULL share."""
    sums = table.groupBy(key).agg(F.sum(part).alias(part), F.sum(whole).alias(whole))
    return sums.withColumn("Share_Percent", share_percent(F.col(part), F.col(whole)))
