"""The batch job: raw tables in, cleaned tables, penetration, growth and forecasts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from uptake.operators import adoption, reconcile
from uptake.operators import forecast as fc
from uptake.plans import preparation, reports, sheets
from uptake.plans.variants import BATCH, Variant
from uptake.sources import readers, sinks


def yearly_outputs(
    yearly: DataFrame, start_year: int, end_year: int, variant: Variant = BATCH
) -> dict[str, DataFrame]:
    names = ("Registrations_Start", "Registrations_End")
    return {
        "cleaned/wheel_fuel_yearly_cleaned": yearly,
        "cleaned/penetration_cleaned": adoption.penetration(yearly),
        f"cleaned/category_cagr_{start_year}_{end_year}": adoption.category_growth(
            yearly, start_year, end_year, variant.cagr_outer, names
        ),
    }


def state_outputs(
    monthly: DataFrame, scored: DataFrame, end: int, variant: Variant = BATCH
) -> dict[str, DataFrame]:
    """A state monthly frame and its forecasts, from the scored rows (see ``forecast.score``)."""
    policy = variant.forecast
    return {
        "cleaned/state_monthly_ev_cleaned": monthly,
        f"state_forecast_monthly_{end}": fc.forecast_rows(scored, ["State"], policy),
        f"state_forecast_{end}_summary": reports.end_year_summary(scored, end, policy),
    }


def run(
    spark: SparkSession, sheet_path: str, state_path: str, out: str,
    reference_path: str | None = None, years: tuple[int, int] = (2015, 2025),
    end: int = fc.FORECAST_END_YEAR, variant: Variant = BATCH,
) -> list[str]:
    """Read a yearly sheet (as CSV) and a state table, write all outputs, return their paths.

    With a reference table the state values are adjusted to it before they are forecast, by their
    adjusted values. The cleaned tables are written first, below ``parquet/`` and partitioned by
    year, and so are the sums of the raw state table and the scored rows; all CSV outputs derive from what was written. So
    each raw file is read once and the model runs once.
    """
    def kept(frame, name, partition_by=()):
        path = f"{out.rstrip('/')}/parquet/{name}"
        sinks.write_parquet(frame, path, partition_by)
        # The partition column would come back last.
        return spark.read.schema(frame.schema).parquet(path).select(*[f"`{c}`" for c in frame.columns])

    sheet = sheets.promote_header(readers.read_grid(spark, sheet_path))
    labels = tuple(name for name in sheet.columns if name.startswith("Unnamed"))[:2]
    yearly = kept(sheets.bands_to_long(sheet, labels, variant), "wheel_fuel_yearly", ("Year",))
    states = kept(preparation.state_sums(readers.read_table(spark, state_path), variant), "state_sums")
    monthly = preparation.state_months(states, variant).electric
    if reference_path:
        reference = sheets.stacked_header_to_long(readers.read_grid(spark, reference_path), variant)
        monthly, _ = reconcile.adjust_to_reference(monthly, reference)
    monthly = kept(monthly, "state_monthly_ev", ("Year",))
    value = fc.state_value_column(monthly.columns)
    scored = kept(fc.score(monthly, ["State"], value, end=end, policy=variant.forecast), "state_scored")
    frames = {**yearly_outputs(yearly, *years, variant), **state_outputs(monthly, scored, end, variant)}
    return sinks.write_outputs(frames, out)
