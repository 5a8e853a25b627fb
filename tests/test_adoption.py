"""Growth, penetration, reconciliation, ranking and change windows on small tables."""

import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F

from uptake.operators import adoption, matching, ranking, reconcile, reshape, rollups, windows
from uptake.plans import reports

# Published registrations of a few categories: totals and electric, 2015 and 2025.
ROWS = [
    ("All Vehicles", "EV", 2015, 2343.0), ("All Vehicles", "EV", 2025, 1964831.0),
    ("3W Passenger", "EV", 2015, 10.0), ("3W Passenger", "EV", 2025, 135266.0),
    ("3W Goods", "EV", 2015, 4.0), ("3W Goods", "EV", 2025, 28044.0),
    ("Bus", "EV", 2015, 3.0), ("Bus", "EV", 2025, 3393.0),
    ("MGV", "EV", 2015, 0.0), ("MGV", "EV", 2025, 0.0),
    ("2W", "EV", 2011, 4068.0), ("2W", "Total", 2011, 10489721.0),
    ("2W", "EV", 2012, 6662.0), ("2W", "Total", 2012, 12378594.0),
    ("2W", "TOTAL ", 2010, 0.0), ("LMV", "Total", 2011, 50.0), ("HMV", "EV", 2011, 5.0),
    ("New", "EV", 2025, 7.0), ("Old", "EV", 2015, 7.0),
]


@pytest.fixture(scope="module")
def yearly(spark):
    frame = spark.createDataFrame(ROWS, "Category string, Fuel_Type string, Year int, Registrations double")
    return frame.withColumn("Is_EV", F.col("Fuel_Type") == "EV")


def test_national_growth(yearly):
    row = adoption.national_growth(yearly, 2015, 2025).first()
    assert (row.Start_EV_Registrations, row.End_EV_Registrations) == (2343.0, 1964831.0)
    assert row.CAGR_Percent == pytest.approx(96.0448, abs=1e-4)
    assert row.Overall_Growth_Percent == pytest.approx((1964831 / 2343 - 1) * 100)
    empty = adoption.national_growth(yearly, 1990, 1991).first()
    assert (empty.Start_EV_Registrations, empty.CAGR_Percent) == (0.0, None)


def test_category_growth(yearly):
    inner = adoption.category_growth(yearly, 2015, 2025, outer=False)
    found = [(c, None if g is None else round(g, 4)) for c, g in values(inner, "Category", "CAGR_Percent")]
    assert found == [("3W Passenger", 158.8921), ("3W Goods", 142.4253), ("Bus", 101.9976), ("MGV", None)]
    outer = dict(values(adoption.category_growth(yearly, 2015, 2025), "Category", "CAGR_Percent"))
    assert outer["Old"] == -100.0 and outer["New"] is None and len(outer) == 6


def test_penetration(yearly):
    table = adoption.penetration(yearly)
    found = {(c, y): (t, e, p) for c, y, t, e, p in values(table)}
    assert found["2W", 2011] == (10489721.0, 4068.0, pytest.approx(0.03878082172061583, abs=1e-12))
    assert found["2W", 2012][2] == pytest.approx(0.05381871337325134, abs=1e-9)
    assert found["2W", 2010] == (0.0, 0.0, None)
    assert found["LMV", 2011] == (50.0, 0.0, 0.0)
    assert ("HMV", 2011) not in found and len(found) == 4
    assert values(adoption.category_penetration(table, 2011), "Category") == [("2W",), ("LMV",)]
    assert adoption.national_penetration(table, 2015, 2025).count() == 0
    assert reports.penetration_kpi(table).first().Year == 2012


MONTHLY = [("a", 2020, 1, 100.0), ("a", 2020, 2, 100.0), ("a", 2021, 1, 5000.0), ("b", 2020, 1, 10.0),
           (None, 2020, 1, 3.0)]
REFERENCE = [("a", 2020, 4000.0), ("a", 2021, 5100.0), ("c", 2020, 9000.0)]


@pytest.fixture(scope="module")
def sources(spark):
    monthly = spark.createDataFrame(MONTHLY, "State string, Year int, Month int, EV_Registrations double")
    reference = spark.createDataFrame(REFERENCE, f"State string, Year int, {reconcile.REFERENCE} double")
    return monthly, reference


def test_compare_sources(sources):
    rows = {(r.State, r.Year): r for r in reconcile.compare_sources(*sources).collect()}
    assert len(rows) == 5
    assert rows["a", 2020].Needs_Review and rows["c", 2020].Needs_Review
    assert rows["a", 2020].Difference == -3800.0
    assert rows["a", 2020].Difference_Percent_vs_Reference == pytest.approx(-95)
    assert not rows["a", 2021].Needs_Review
    assert rows["b", 2020].Difference_Percent_vs_Reference is None and not rows["b", 2020].Needs_Review
    ordered = reconcile.compare_sources(*sources).collect()
    assert [r.State for r in ordered[:2]] == ["a", "c"]


def test_adjustment(sources):
    adjusted, factors = reconcile.adjust_to_reference(*sources)
    by_key = {(r.State, r.Year): r for r in factors.collect()}
    assert by_key["a", 2020].Adjustment_Factor == 20.0
    # Without monthly rows there is nothing to scale.
    assert not by_key["c", 2020].Use_Reference_Adjustment and by_key["c", 2020].Adjustment_Factor == 1.0
    rows = adjusted.collect()
    assert len(rows) == len(MONTHLY)
    scaled = {r.State: 0.0 for r in rows}
    for r in rows:
        if r.Use_Reference_Adjustment:
            scaled[r.State] += r.EV_Registrations_Adjusted
        else:
            assert r.EV_Registrations_Adjusted == r.EV_Registrations_Original
    assert scaled["a"] == 4000.0
    loose, _ = reconcile.adjust_to_reference(*sources, threshold_abs=1e9)
    assert loose.where("Use_Reference_Adjustment").count() == 0


def test_merge_sums_and_joins(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0)], "k string, v double")
    right = spark.createDataFrame([("b", 4.0), (None, 6.0)], "k string, v double")
    found = matching.merge_sums(["k"], x=(left, "v"), y=(right, "v"))
    assert sorted(values(found), key=str) == [("a", 3.0, 0.0), ("b", 0.0, 4.0), (None, 5.0, 6.0)]
    assert sorted(values(matching.inner_pair(left, left, ["k"], "v", ("p", "q")))) == [
        ("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 2.0, 2.0)]
    extra = right.withColumnRenamed("v", "w")
    filled = matching.left_fill(left, extra, ["k"], {"w": 0.0})
    assert sorted(values(filled, "w")) == [(0.0,), (0.0,), (0.0,)]


def test_change_windows(spark):
    days = [(dt.date(2020 + i // 12, i % 12 + 1, 1), float(i)) for i in range(26) if i != 5]
    frame = spark.createDataFrame(days, "Date date, v double")
    by_row = dict(values(windows.change_by_row(frame, "v", "c", "Date", 12), "Date", "c"))
    # January 2021 is only the eleventh later row, because one month is missing.
    assert by_row[dt.date(2021, 1, 1)] is None
    assert by_row[dt.date(2021, 2, 1)] is None  # base 0
    assert by_row[dt.date(2021, 3, 1)] == pytest.approx(1300)
    by_month = dict(values(windows.change_by_calendar(frame, "v", "c", "Date"), "Date", "c"))
    assert by_month[dt.date(2021, 2, 1)] == pytest.approx(1200)
    assert by_month[dt.date(2021, 6, 1)] is None
    endless = dict(values(windows.change_by_row(frame, "v", "c", "Date", 12, infinite=True), "Date", "c"))
    assert endless[dt.date(2021, 2, 1)] == float("inf")
    grown = reports.monthly_growth(frame.withColumnRenamed("v", "EV_Registrations"), only_known=True)
    assert grown.count() == 12


def test_ranking(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "k string, v double")
    assert values(ranking.top_k(frame, "v", 2, ["k"]), "k") == [("b",), ("c",)]
    assert values(ranking.arg_max(frame, "v", "k")) == [("b", 3.0)]
    assert values(ranking.head(frame, ["v"], 1), "k") == [("a",)]
    assert values(ranking.tail(frame, ["k"], 2), "k") == [("d",), ("c",)]
    assert values(ranking.latest_rows(frame, "k")) == [("d", None)]


def test_rollups(spark):
    days = [dt.date(2020, m, 3) for m in range(1, 13)] + [dt.date(2021, 1, 1), dt.date(2021, 1, 2), None]
    frame = spark.createDataFrame([(d,) for d in days], "Date date")
    assert values(rollups.latest_complete_year(frame)) == [(2020,)]
    assert values(rollups.latest_complete_year(frame.where("Date > '2020-06-01'"))) == [(2021,)]
    years = frame.select(F.year("Date").alias("Year"))
    assert values(rollups.default_year(years, 2020)) == [(2020,)]
    assert values(rollups.default_year(years, 2023)) == [(2021,)]
    assert values(rollups.shape(frame)) == [(15, 1)]
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert values(rollups.sum_by(empty, ["k"], "v")) == [("a", 0.0)]
    assert values(rollups.value_counts(years.dropna(), "Year")) == [(2020, 12), (2021, 2)]


def test_seasonality_and_shares(spark):
    frame = spark.createDataFrame([(2020, 1, 2.0), (2020, 1, 3.0), (2020, 12, 4.0)], "Year int, Month int, v double")
    row = reshape.seasonality(frame, "v").first()
    assert (row.Jan, row.Feb, row.Dec) == (5.0, None, 4.0)
    wide = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "a int, b int, t int")
    assert values(reports.total_mismatches(wide, ["a", "b"], "t"), "t", "Gap") == [(4, 1.0)]
    shares = spark.createDataFrame([("x", 1.0, 4.0), ("y", None, 4.0)], "k string, e double, t double")
    assert dict(values(reports.share_table(shares, "k", "e", "t"), "k", "Share_Percent")) == {"x": 25.0, "y": None}


def test_state_reports(spark):
    rows = [("a", 2020, 5.0), ("a", 2021, 7.0), ("b", 2020, 9.0)]
    monthly = spark.createDataFrame(rows, "State string, Year int, EV_Registrations double")
    assert values(reports.top_states(monthly, 2020, 1), "State") == [("b",)]
    assert values(reports.state_trend(monthly, "a"), "Year", "EV_Registrations") == [(2020, 5.0), (2021, 7.0)]
    assert values(reports.annual_total(monthly)) == [(2020, 14.0), (2021, 7.0)]
