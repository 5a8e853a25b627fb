"""Forecasts against a NumPy ridge and plain Python fallbacks."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from uptake.operators import forecast as fc
from uptake.operators.windows import tail_statistics
from uptake.plans import reports
from uptake.plans.variants import BATCH, DASHBOARD, DEFAULT

GROWTH, MEAN, PLAIN = DEFAULT.forecast, DASHBOARD.forecast, BATCH.forecast
EV = "EV_Registrations"


def month(index, start=(2018, 1)):
    position = start[0] * 12 + start[1] - 1 + index
    return dt.date(position // 12, position % 12 + 1, 1)


def frame(spark, series):
    """series: {key: {month offset: value}}"""
    rows = [(key, month(i), float(v)) for key, cells in series.items() for i, v in cells.items()]
    return spark.createDataFrame(rows, f"State string, Date date, {EV} double")


def ridge(y, degree):
    """Fitted function, R2 and residual deviation of a ridge with a free intercept."""
    t = np.arange(len(y), dtype=float)
    x = np.column_stack([t ** d for d in range(1, degree + 1)])
    centre = x.mean(axis=0)
    a = (x - centre).T @ (x - centre) + np.eye(degree)
    w = np.linalg.solve(a, (x - centre).T @ (y - y.mean()))
    b = y.mean() - centre @ w
    fitted = x @ w + b

    def at(step):
        return b + sum(w[d - 1] * step ** d for d in range(1, degree + 1))

    return at, 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.std(y - fitted)


def collect(df, keys, policy, end=2022):
    scored = fc.score(df, keys, end=end, policy=policy)
    rows = fc.forecast_rows(scored, keys, policy).orderBy(*keys, "Date").collect()
    return rows, fc.metrics(scored, keys, policy).collect()


@pytest.mark.parametrize("n,policy,degree", [
    (40, GROWTH, 2), (24, GROWTH, 2), (23, GROWTH, 1), (23, MEAN, 2), (30, replace(GROWTH, degree=1), 1),
])
def test_model_matches_numpy(spark, n, policy, degree):
    rng = np.random.default_rng(n)
    y = np.round(50 + 3 * np.arange(n) + rng.normal(0, 20, n)).clip(1)
    rows, metrics = collect(frame(spark, {"a": dict(enumerate(y))}), ["State"], policy)
    at, r2, sd = ridge(y, degree)
    assert len(rows) == 60
    for i, row in enumerate(rows):
        assert row.Date == month(i) and (row.Year, row.Month) == (row.Date.year, row.Date.month)
        assert row.Actual == (y[i] if i < n else None)
        predicted = max(at(i), 0)
        assert row.Predicted == pytest.approx(predicted, rel=1e-9, abs=1e-6)
        assert row.CI_Lower == pytest.approx(max(predicted - 1.96 * sd, 0), rel=1e-8, abs=1e-6)
        assert row.CI_Upper == pytest.approx(predicted + 1.96 * sd, rel=1e-8)
        assert row.CI_Lower <= row.Predicted <= row.CI_Upper
    assert metrics[0].Model_Fit_Score == pytest.approx(r2, rel=1e-9)
    assert metrics[0].Forecast_Method == "Polynomial Ridge Regression"
    assert metrics[0].Last_Actual_Month == month(n - 1).strftime("%b %Y")


def scaled_ridge(y, degree):
    """As ``ridge``, for any degree: least squares on scaled columns, with a row per penalty."""
    t = np.arange(len(y), dtype=float)
    x = np.column_stack([t ** d for d in range(1, degree + 1)])
    centre, size = x.mean(axis=0), np.abs(x).max(axis=0)
    a = np.vstack([(x - centre) / size, np.diag(1 / size)])
    w = np.linalg.lstsq(a, np.concatenate([y - y.mean(), np.zeros(degree)]), rcond=None)[0] / size
    fitted = y.mean() + (x - centre) @ w

    def at(step):
        return y.mean() + sum(w[d - 1] * (step ** d - centre[d - 1]) for d in range(1, degree + 1))
    return at, 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.std(y - fitted)


@pytest.mark.parametrize("n,degree", [(6, 5), (25, 3), (132, 4)])
def test_any_degree_matches_numpy(spark, n, degree):
    rng = np.random.default_rng(n + degree)
    cells = {i: float(np.round(5000 + 40 * i + 900 * np.sin(i / 5) + rng.normal(0, 100))) for i in range(n) if i % 7 != 3 or i == n - 1}
    y = np.array([cells.get(i, 0.0) for i in range(n)])
    policy = replace(MEAN, degree=degree)
    scored = fc.score(frame(spark, {"a": cells, "b": {0: 1.0}, "c": {i: 7.0 for i in range(n)}}), ["State"], end=2030, policy=policy)
    rows = fc.forecast_rows(scored, ["State"], policy).orderBy("Date").collect()
    fit = {r.State: r for r in fc.metrics(scored, ["State"], policy).collect()}
    at, r2, sd = scaled_ridge(y, degree)
    mine = [r for r in rows if r.State == "a"]
    assert len(mine) == 156
    for i, row in enumerate(mine):
        predicted = max(at(i), 0)
        assert row.Predicted == pytest.approx(predicted, rel=1e-6, abs=1e-6 * y.max())
        assert row.CI_Upper - row.Predicted == pytest.approx(1.96 * sd, rel=1e-6, abs=1e-3)
    assert fit["a"].Model_Fit_Score == pytest.approx(r2, rel=1e-6)
    assert fit["b"].Forecast_Method == "Fallback Average"
    assert fit["c"].Model_Fit_Score == 1 and {r.Predicted for r in rows if r.State == "c"} == {7.0}


def test_higher_degrees_add_no_shuffle_and_have_a_limit(spark):
    policy = replace(MEAN, degree=4)
    rows = fc.forecast_rows(fc.score(frame(spark, {"a": {0: 1.0, 30: 4.0}}), ["State"], end=2022, policy=policy), ["State"], policy)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    with pytest.raises(ValueError, match="degree"):
        fc.score(rows, ["State"], policy=replace(MEAN, degree=6))
    # An adaptive degree is a parabola at most.
    cells = {i: float(i * i % 17 + i) for i in range(40)}
    one, two = (collect(frame(spark, {"a": cells}), ["State"], replace(GROWTH, degree=d))[0] for d in (2, 5))
    assert one == two


def test_gaps_count_as_zero_and_predictions_stop_at_zero(spark):
    cells = {i: 200.0 - 8 * i for i in range(0, 24, 2)}
    y = np.array([cells.get(i, 0.0) for i in range(23)])
    rows, _ = collect(frame(spark, {"a": cells}), ["State"], GROWTH)
    at, _, _ = ridge(y, 1)
    assert [r.Actual for r in rows[:23]] == list(y)
    assert rows[30].Predicted == pytest.approx(max(at(30), 0), abs=1e-6)
    assert min(r.Predicted for r in rows) == 0.0


def test_leading_zeros(spark):
    cells = {i: (0.0 if i < 10 else 5.0 + i) for i in range(20)}
    df = frame(spark, {"a": cells})
    trimmed, _ = collect(df, ["State"], GROWTH)
    kept, _ = collect(df, ["State"], MEAN)
    assert trimmed[0].Date == month(10) and kept[0].Date == month(0)
    assert len(kept) == len(trimmed) + 10


def test_growth_fallback(spark):
    # Two positive years: the rate between them, capped at 35 percent a year.
    cells = {10: 10.0, 11: 10.0, 12: 30.0}
    rows, metrics = collect(frame(spark, {"a": cells}), ["State"], GROWTH)
    base = 50 / 3
    rate = 1.35 ** (1 / 12) - 1
    spread = 1.96 * np.std([10, 10, 30])
    future = [r for r in rows if r.Actual is None]
    for i, row in enumerate(future, start=1):
        expected = base * (1 + rate) ** i
        assert row.Predicted == pytest.approx(expected)
        assert row.CI_Upper == pytest.approx(expected + spread)
    assert [r.Predicted for r in rows[:3]] == [10.0, 10.0, 30.0]
    assert metrics[0].Model_Fit_Score is None and metrics[0].Forecast_Method == "Growth Fallback"


@pytest.mark.parametrize("cells,annual", [
    ({0: 12.0}, 0.05),                       # one year: the default
    ({0: 100.0, 12: 95.0, 13: 0.0}, -0.05),  # falling
    ({0: 100.0, 12: 1.0}, -0.10),            # falling fast: the floor
    ({0: 0.0, 3: 0.0}, 0.05),                # nothing positive at all
])
def test_growth_rates(spark, cells, annual):
    rows, _ = collect(frame(spark, {"a": cells}), ["State"], replace(GROWTH, min_periods=1000))
    first = next(i for i, v in sorted(cells.items()) if v > 0) if any(cells.values()) else 0
    last = max(cells)
    y = [cells.get(i, 0.0) for i in range(first, last + 1)]
    base = np.mean(y[-6:])
    future = [r.Predicted for r in rows if r.Actual is None]
    rate = (1 + annual) ** (1 / 12) - 1
    assert future[0] == pytest.approx(base * (1 + rate))
    assert future[23] == pytest.approx(base * (1 + rate) ** 24)


def test_mean_fallback(spark):
    cells = {i: float(i) for i in range(1, 4)}
    rows, metrics = collect(frame(spark, {"a": cells}), ["State"], MEAN)
    future = [r for r in rows if r.Actual is None]
    assert {r.Predicted for r in future} == {2.0}
    assert future[0].CI_Upper == pytest.approx(2 + 1.96 * np.std([1, 2, 3]))
    assert metrics[0].Forecast_Method == "Fallback Average"
    bare = fc.forecast_rows(fc.score(frame(spark, {"a": cells}), ["State"], policy=PLAIN), ["State"], PLAIN)
    assert bare.columns == ["State", "Date", "Actual", "Predicted", "Year", "Month"]


def test_single_month_has_no_spread(spark):
    rows, _ = collect(frame(spark, {"a": {0: 4.0}}), ["State"], MEAN, end=2018)
    assert len(rows) == 12 and {r.CI_Upper for r in rows} == {4.0}


def test_constant_series_fits_perfectly(spark):
    rows, metrics = collect(frame(spark, {"a": {i: 7.3 for i in range(30)}}), ["State"], GROWTH)
    assert metrics[0].Model_Fit_Score == 1.0
    assert rows[-1].Predicted == pytest.approx(7.3) and rows[-1].CI_Upper == pytest.approx(7.3)


def test_horizon_already_past(spark):
    rows, _ = collect(frame(spark, {"a": {i: 1.0 + i for i in range(30)}}), ["State"], GROWTH, end=2019)
    assert len(rows) == 30 and all(r.Actual is not None for r in rows)


def test_many_series_are_independent(spark):
    rng = np.random.default_rng(1)
    series = {f"s{k}": {i: float(rng.integers(0, 9)) for i in range(k)} for k in range(1, 31)}
    together, _ = collect(frame(spark, series), ["State"], GROWTH)
    for key in ("s1", "s5", "s29"):
        alone, _ = collect(frame(spark, {key: series[key]}), ["State"], GROWTH)
        mine = [r for r in together if r.State == key]
        assert [tuple(r) for r in mine] == [tuple(r) for r in alone]


def test_raw_rows_mid_month_dates_and_text_values(spark):
    rows = [("a", dt.date(2018, 1 + i // 3, 3 + i % 3), "1,0") for i in range(30)]
    df = spark.createDataFrame(rows, f"State string, Date date, {EV} string")
    found, metrics = collect(df, ["State"], GROWTH)
    assert [r.Actual for r in found[:10]] == [30.0] * 10
    assert metrics[0].Nonzero_EV_Months == 10


def test_negative_values(spark):
    df = frame(spark, {"a": {0: 5.0, 1: -3.0, 2: 6.0, 3: 7.0}})
    clipped, _ = collect(df, ["State"], GROWTH)
    assert [r.Actual for r in clipped[:4]] == [5.0, 0.0, 6.0, 7.0]
    dropped = fc.score(frame(spark, {"a": {0: -5.0, 1: 2.0, 2: 6.0}}), ["State"], policy=PLAIN, end=2018)
    assert dropped.where("Step = 0").first().Period == 2018 * 12 + 1


def test_null_dates_and_null_keys(spark):
    df = spark.createDataFrame(
        [(None, month(0), 1.0), (None, month(1), 1.0), ("a", None, 9.0)], f"State string, Date date, {EV} double")
    rows, _ = collect(df, ["State"], MEAN, end=2018)
    assert {r.State for r in rows} == {None} and len(rows) == 12


def test_no_key_is_one_series(spark):
    df = frame(spark, {"a": {i: 10.0 + i for i in range(12)}, "b": {i: 1.0 for i in range(12)}})
    scored = fc.score(df, end=2019)
    rows = fc.forecast_rows(scored).orderBy("Date").collect()
    assert [r.Actual for r in rows[:12]] == [11.0 + i for i in range(12)]
    assert fc.metrics(scored, []).count() == 1


def test_bad_degree(spark):
    with pytest.raises(ValueError):
        fc.score(frame(spark, {"a": {0: 1.0}}), ["State"], policy=replace(GROWTH, degree=0))


@pytest.mark.parametrize("fit,months,policy,expected", [
    (0.5, 36, GROWTH, "High"), (0.49, 36, GROWTH, "Medium"), (None, 36, GROWTH, "High"),
    (None, 36, MEAN, "Medium"), (0.9, 35, GROWTH, "Medium"), (0.9, 18, GROWTH, "Medium"),
    (0.9, 17, GROWTH, "Low"),
])
def test_confidence(spark, fit, months, policy, expected):
    df = spark.createDataFrame([(fit, months)], "f double, m int")
    assert df.select(fc.confidence_tier(F.col("f"), F.col("m"), policy)).first()[0] == expected


def test_densify_spans_the_calendar(spark):
    df = frame(spark, {"a": {0: 0.0, 3: 4.0, 7: 1.0}, "b": {5: 2.0}})
    dense = fc.densify(df, ["State"])
    assert dense.where("State = 'a'").count() == 8 and dense.where("State = 'b'").count() == 1
    assert fc.densify(df, ["State"], trim=True).where("State = 'a'").count() == 5
    stats = tail_statistics(dense, EV, "Date", 6, ["State"]).where("State = 'a'").first()
    tail = [0.0, 4.0, 0.0, 0.0, 0.0, 1.0]
    assert stats.Tail_Mean == pytest.approx(np.mean(tail))
    assert stats.Tail_Std == pytest.approx(np.std(tail))


def test_reports_over_scores(spark):
    cells = {i: 5.0 + i for i in range(30)}
    df = frame(spark, {"a": cells, "b": {0: 1.0}})
    scored = fc.score(df, ["State"], end=2022)
    outlook = reports.state_outlook(scored, 2022, 2019).collect()
    assert [r.State for r in outlook] == ["a", "b"]
    assert outlook[0].Actual_EV_Registrations_2019 == sum(cells[i] for i in range(12, 24))
    assert outlook[1].Actual_EV_Registrations_2019 is None
    assert outlook[1].Growth_vs_2019_Percent is None
    growth = (outlook[0].Predicted_EV_Registrations / outlook[0].Actual_EV_Registrations_2019 - 1) * 100
    assert outlook[0].Growth_vs_2019_Percent == pytest.approx(growth)
    kpi = reports.outlook_kpis(scored, 2022).first()
    assert tuple(kpi) == (2, 0, "Jun 2020")
    trend = reports.combined_trend(scored, df, "b")
    kinds = dict(values(trend.groupBy("Data_Type").count()))
    assert kinds == {"Actual": 1, "Fitted": 30, "Forecast": 30}
    summary = reports.end_year_summary(scored, 2022)
    assert summary.columns == [
        "State", "Predicted_EV_Registrations_2022", "Model_Fit_Score", "Nonzero_EV_Months",
        "Forecast_Method", "Forecast_Confidence"]


def test_annual_outlook(spark):
    df = frame(spark, {"a": {i: 100.0 + i for i in range(30)}})
    rows = reports.annual_outlook(fc.score(df, end=2022)).collect()
    assert [(r.Year, r.Data_Type) for r in rows] == [
        (2018, "Actual"), (2019, "Actual"), (2020, "Actual"), (2021, "Forecast"), (2022, "Forecast")]
    assert rows[0].Actual_EV_Registrations == sum(100.0 + i for i in range(12))
    assert rows[4].Actual_EV_Registrations is None and rows[0].Forecast_YoY_Growth_Percent is None
    ratio = rows[1].Predicted_EV_Registrations / rows[0].Predicted_EV_Registrations
    assert math.isclose(rows[1].Forecast_YoY_Growth_Percent, (ratio - 1) * 100)
