"""The switches by which one implementation covers the known variants of the analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from uptake.functions import numeric


@dataclass(frozen=True)
class ForecastPolicy:
    """How a series is prepared, modelled and graded."""

    trim_leading_zeros: bool = True
    """Start a series at its first positive period."""
    adaptive_degree: bool = True
    """Use a straight line for series shorter than ``quadratic_from`` periods."""
    degree: int = 2
    quadratic_from: int = 24
    ridge: float = 1.0
    min_periods: int = 6
    min_positive: int = 4
    clip_negative: bool = True
    """Raise negative inputs to 0; otherwise negative period sums are dropped."""
    fallback: str = "growth"
    """``growth``: last level grown at the series' own annual rate. ``mean``: last level held."""
    base_periods: int = 6
    band_periods: int = 12
    """How many last periods give the spread of a fallback series."""
    band: bool = True
    """Give the indicative range columns."""
    default_growth: float = 5.0
    growth_limits: tuple[float, float] = (-0.10, 0.35)
    high_without_fit: bool = True
    """A long series without a fit score may still be graded High."""

    @property
    def fallback_name(self) -> str:
        return {"growth": "Growth Fallback", "mean": "Fallback Average"}[self.fallback]


@dataclass(frozen=True)
class Variant:
    """Cleaning and reporting switches."""

    number_markers: tuple[str, ...] = numeric.MARKERS_DEFAULT
    state_style: str = "spaced"
    yearly_fuel_style: str = "title"
    state_fuel_style: str = "title"
    ev_match: str = "squeezed"
    category_style: str = "plain"
    strict_year_columns: bool = True
    standard_wheel_labels: bool = True
    wheel_aliases: bool = True
    drop_footers: bool = True
    merge_yearly_rows: bool = True
    clip_negative: bool = True
    cagr_outer: bool = True
    forecast: ForecastPolicy = field(default_factory=ForecastPolicy)


DEFAULT = Variant()

DASHBOARD = Variant(
    number_markers=numeric.MARKERS_DASHBOARD,
    state_style="joined",
    yearly_fuel_style="raw",
    state_fuel_style="trimmed",
    ev_match="compact",
    category_style="prefixed",
    strict_year_columns=False,
    wheel_aliases=False,
    drop_footers=False,
    merge_yearly_rows=False,
    cagr_outer=False,
    forecast=ForecastPolicy(
        trim_leading_zeros=False, adaptive_degree=False, fallback="mean", band_periods=6,
        high_without_fit=False,
    ),
)

BATCH = Variant(
    number_markers=numeric.MARKERS_BATCH,
    state_style="joined",
    yearly_fuel_style="raw",
    state_fuel_style="raw",
    ev_match="exact",
    strict_year_columns=False,
    standard_wheel_labels=False,
    wheel_aliases=False,
    drop_footers=False,
    merge_yearly_rows=False,
    clip_negative=False,
    cagr_outer=False,
    forecast=ForecastPolicy(
        trim_leading_zeros=False, adaptive_degree=False, fallback="mean", band_periods=6,
        band=False, clip_negative=False, high_without_fit=False,
    ),
)
