"""Comparison of a monthly source with an annual reference, and the adjustment it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uptake.functions.numeric import pct_change
from uptake.operators.matching import merge_sums
from uptake.operators.ranking import ascending

KEYS = ["State", "Year"]
REFERENCE = "Reference_EV_Registrations"
MONTHLY = "Monthly_File_EV_Registrations"
ADDED = ("Adjustment_Factor", "Use_Reference_Adjustment", "EV_Registrations_Original", "EV_Registrations_Adjusted")


def _with_difference(annual: DataFrame) -> DataFrame:
    return annual.withColumns({
        "Difference": F.col(MONTHLY) - F.col(REFERENCE),
        "Difference_Percent_vs_Reference": pct_change(F.col(MONTHLY), F.col(REFERENCE)),
    })


def annual_sums(monthly: DataFrame, reference: DataFrame) -> DataFrame:
    """State, Year and both annual sums, 0 where a side has none."""
    return merge_sums(
        KEYS, **{REFERENCE: (reference, REFERENCE), MONTHLY: (monthly, "EV_Registrations")}
    )


def _far_apart(threshold_abs: float, threshold_pct: float) -> Column:
    apart = (F.abs("Difference") > threshold_abs) & (
        F.abs("Difference_Percent_vs_Reference") > threshold_pct
    )
    return F.coalesce(apart, F.lit(False)) & (F.col(REFERENCE) > 0)


def compare_sources(
    monthly: DataFrame, reference: DataFrame, threshold_abs: float = 1000,
    threshold_pct: float = 25,
) -> DataFrame:
    """Annual difference per state and year, with the pairs that need review first."""
    return review(annual_sums(monthly, reference), threshold_abs, threshold_pct)


def review(annual: DataFrame, threshold_abs: float = 1000, threshold_pct: float = 25) -> DataFrame:
    """``compare_sources`` for sums that lie side by side."""
    flagged = _with_difference(annual).withColumn(
        "Needs_Review", _far_apart(threshold_abs, threshold_pct)
    )
    return flagged.orderBy(F.desc("Needs_Review"), F.desc("Difference"), *ascending(*KEYS))


def adjustment_factors(
    monthly: DataFrame, reference: DataFrame, threshold_abs: float = 1000,
    threshold_pct: float = 25,
) -> DataFrame:
    """Per state and year: whether to scale the monthly values to the reference, and by how much."""
    return factors(annual_sums(monthly, reference), threshold_abs, threshold_pct)


def factors(annual: DataFrame, threshold_abs: float = 1000, threshold_pct: float = 25) -> DataFrame:
    """``adjustment_factors`` for sums that lie side by side."""
    return _with_factor(_with_difference(annual), threshold_abs, threshold_pct)


def _with_factor(annual: DataFrame, threshold_abs: float, threshold_pct: float) -> DataFrame:
    use = _far_apart(threshold_abs, threshold_pct) & (F.col(MONTHLY) > 0)
    ratio = F.try_divide(F.col(REFERENCE), F.col(MONTHLY))
    finite = F.when(F.abs(ratio) < float("inf"), ratio)
    factor = F.when(F.col("Use_Reference_Adjustment"), F.coalesce(finite, F.lit(1.0))).otherwise(1.0)
    return annual.withColumn("Use_Reference_Adjustment", use).withColumn("Adjustment_Factor", factor)


def adjust(
    monthly: DataFrame, reference: str, threshold_abs: float = 1000, threshold_pct: float = 25,
) -> DataFrame:
    """Monthly values scaled to the reference where both are far apart.

    ``reference`` names a column of ``monthly`` whose sum per state and year is the reference; the
    column is dropped. Adds Adjustment_Factor, Use_Reference_Adjustment, EV_Registrations_Original
    and EV_Registrations_Adjusted. One window per state and year holds a calendar year of rows, so
    there is one shuffle and no join; NULL states match each other.
    """
    amount = F.col("EV_Registrations").cast("double")
    year = Window.partitionBy(*KEYS)
    sums = monthly.withColumns({
        REFERENCE: F.coalesce(F.sum(F.col(reference).cast("double")).over(year), F.lit(0.0)),
        MONTHLY: F.coalesce(F.sum(amount).over(year), F.lit(0.0)),
    })
    scaled = _with_factor(_with_difference(sums), threshold_abs, threshold_pct).withColumns({
        "EV_Registrations_Original": F.col("EV_Registrations"),
        "EV_Registrations_Adjusted": amount * F.col("Adjustment_Factor"),
    })
    return scaled.select(*[f"`{c}`" for c in monthly.columns if c != reference], *ADDED)


def adjust_to_reference(
    monthly: DataFrame, reference: DataFrame, threshold_abs: float = 1000,
    threshold_pct: float = 25,
) -> tuple[DataFrame, DataFrame]:
    """The adjusted monthly frame (see ``adjust``) and the annual frame of factors.

    Monthly and reference rows are stacked for the window; a state and year without a reference
    keeps its values.
    """
    lane = reference.select(*KEYS, F.col(REFERENCE).alias("__reference"), F.lit(False).alias("__monthly"))
    stacked = monthly.withColumn("__monthly", F.lit(True)).unionByName(lane, allowMissingColumns=True)
    adjusted = adjust(stacked, "__reference", threshold_abs, threshold_pct).where("__monthly").drop("__monthly")
    return adjusted, adjustment_factors(monthly, reference, threshold_abs, threshold_pct)
