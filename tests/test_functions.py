"""Scalar functions against plain Python."""

import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uptake.functions import dates, labels, numeric, text

NBSP, ZWSP = chr(0xA0), chr(0x200B)


def apply(spark, inputs, function, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    rows = frame.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [row.r for row in rows]


NUMBERS = [
    "1,234", " 12 ", "NA", "nan", "NaN", "1e3", "1E+3", "+5", "-7.5", ".5", "5.", "1d", "1f", "0x10",
    "True", "1_000", "1 000", "- 5", "", "1e", "abc", "12NA", f"{NBSP}5{NBSP}", "1.5.2", "00012",
    "1e400", "inf", "-Infinity", "infinit", None,
]


@pytest.mark.parametrize("markers", [
    numeric.MARKERS_DEFAULT, numeric.MARKERS_DASHBOARD, numeric.MARKERS_BATCH,
])
def test_clean_num_reads_what_pandas_reads(spark, markers):
    def expected(value):
        bare = str(value).replace(",", "")
        for marker in markers:
            bare = bare.replace(marker, "")
        number = pd.to_numeric(pd.Series([bare.strip()], dtype=object), errors="coerce")[0]
        return None if pd.isna(number) else float(number)

    found = apply(spark, NUMBERS, lambda c: numeric.clean_num(c, markers))
    assert found == [None if v is None else expected(v) for v in NUMBERS]


def test_as_number_on_numeric_columns(spark):
    frame = spark.createDataFrame([(1, 2.5), (None, float("nan"))], "a long, b double")
    rows = frame.select(numeric.as_number(frame, "a"), numeric.as_number(frame, "b")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.5), (None, None)]


def test_fill_and_clip(spark):
    assert apply(spark, [None, -2.0, 3.0], numeric.fill_and_clip, "double") == [0.0, 0.0, 3.0]
    assert apply(spark, [None, -2.0, 3.0], numeric.clip_low, "double") == [None, 0.0, 3.0]


@pytest.mark.parametrize("now,before,expected", [
    (3.0, 2.0, 50.0), (3.0, 0.0, None), (None, 2.0, None), (3.0, None, None), (1.0, -2.0, -150.0),
])
def test_pct_change(spark, now, before, expected):
    frame = spark.createDataFrame([(now, before)], "n double, b double")
    assert frame.select(numeric.pct_change(F.col("n"), F.col("b"))).first()[0] == expected


@pytest.mark.parametrize("start,end,years,expected", [
    (100.0, 121.0, 2, 10.0), (0.0, 5.0, 2, None), (-1.0, 5.0, 2, None), (100.0, 0.0, 2, -100.0),
    (100.0, -4.0, 2, None), (100.0, 121.0, 0, None), (None, 121.0, 2, None), (100.0, None, 2, None),
])
def test_cagr(spark, start, end, years, expected):
    frame = spark.createDataFrame([(start, end)], "s double, e double")
    found = frame.select(numeric.cagr(F.col("s"), F.col("e"), years)).first()[0]
    assert found == (expected if expected is None else pytest.approx(expected))


def test_overall_growth_and_share(spark):
    frame = spark.createDataFrame([(2.0, 5.0), (0.0, 5.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = frame.select(numeric.overall_growth(a, b), numeric.share_percent(b, a)).collect()
    assert [tuple(r) for r in rows] == [(150.0, 250.0), (None, None)]


TITLES = [
    "electric(bov)", "petrol/cng", "they're", "2w bus", "FOO-bar baz", "  x  ", "straße", "ß x",
    "éLAN vital", "", "a1b2", "x_y", f"a{NBSP}b", "ÀÉ", "日本語abc", "ªbc",
]


def test_title_case_like_python(spark):
    assert apply(spark, TITLES, text.title_case) == [t.title() for t in TITLES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aZé1 .-_/&() \t \x1c　", max_size=12), min_size=1, max_size=8))
def test_text_functions_like_python(spark, inputs):
    assert apply(spark, inputs, text.title_case) == [t.title() for t in inputs]
    assert apply(spark, inputs, text.strip) == [t.strip() for t in inputs]
    assert apply(spark, inputs, text.squeeze) == [re.sub(r"\s+", " ", t).strip() for t in inputs]


def test_state_names(spark):
    raw = [
        "jammu & kashmir", "Jammu&Kashmir", f"nct{NBSP}of   delhi", "UT of DNH and DD",
        "andaman & nicobar island", "TAMIL  nadu", None,
    ]
    assert apply(spark, raw, labels.state_name) == [
        "Jammu And Kashmir", "Jammu And Kashmir", "Delhi",
        "Dadra And Nagar Haveli And Daman And Diu", "Andaman And Nicobar Islands", "Tamil Nadu", None,
    ]
    joined = apply(spark, raw, lambda c: labels.state_name(c, "joined"))
    assert joined[:3] == ["Jammu And Kashmir", "Jammuandkashmir", "Delhi"]


def test_wheel_categories(spark):
    raw = [
        "ALL VEHICLE classes", "2w", "x 2w", "Two Wheeler (T)", "3W passenger", "3w goods car",
        "Three Wheeler (Passenger)", "motor cab", "cargo", "mini bus", "LGV", "above 12 tonnes",
        "other", "road roller", None,
    ]
    assert apply(spark, raw, labels.wheel_category) == [
        "All Vehicles", "2W", "X 2W", "2W", "3W Passenger", "3W Goods", "3W Passenger", "Cars",
        "Cars", "Buses", "Goods Vehicles", "Goods Vehicles", "Others", "Road Roller", None,
    ]
    plain = apply(spark, ["Three Wheeler (Goods)"], lambda c: labels.wheel_category(c, False))
    assert plain == ["Three Wheeler (Goods)"]


def test_monthly_categories(spark):
    raw = ["Electric_2W", "electric 3 w", "Electric_4W", "Electric_Goods", "Electric_Bus", "e_rickshaw"]
    assert apply(spark, raw, labels.monthly_category) == [
        "2W", "3W", "Cars", "Goods Vehicles", "Buses", "E Rickshaw",
    ]
    assert apply(spark, raw, lambda c: labels.monthly_category(c, "prefixed"))[:5] == [
        "Electric 2W", "Electric 3W", "Electric Cars", "Electric Goods", "Electric Bus",
    ]


def test_ev_fuels(spark):
    raw = ["EV", " Electric (BOV) ", "electric  (bov)", "elec tric", "Strong Hybrid EV", "electric bov",
           "petrol", None]
    assert apply(spark, raw, labels.is_ev_fuel) == [True, True, True, False, False, True, False, False]
    assert apply(spark, raw, lambda c: labels.is_ev_fuel(c, "compact")) == [
        True, True, True, True, False, True, False, False]
    assert apply(spark, raw, lambda c: labels.is_ev_fuel(c, "exact")) == [
        True, True, False, False, False, True, False, False]


def test_fuel_labels(spark):
    raw = [" Electric  (BOV) "]
    assert apply(spark, raw, labels.fuel_label) == ["Electric (Bov)"]
    assert apply(spark, raw, lambda c: labels.fuel_label(c, "compact")) == ["electric(bov)"]
    assert apply(spark, raw, lambda c: labels.fuel_label(c, "trimmed")) == ["Electric  (BOV)"]


def test_dates(spark):
    frame = spark.createDataFrame(
        [("FY2015", "Jan"), ("2016", " FEB "), ("2016", "Sept"), ("x", "Mar"), ("2016", None)],
        "y string, m string",
    )
    found = frame.select(dates.parse_year_month(F.col("y"), F.col("m")).cast("string")).collect()
    assert [r[0] for r in found] == ["2015-01-01", "2016-02-01", None, None, None]
    for name, pattern in (("January", "MMMM"), ("1", "M"), ("01", "M")):
        month = dates.parse_year_month(F.lit("2015"), F.lit(name), pattern).cast("string")
        assert spark.range(1).select(month).first()[0] == "2015-01-01"
    assert apply(spark, ["2021-02-30", "2021-02-03", "bad", None],
                 lambda c: dates.parse_date(c).cast("string")) == [None, "2021-02-03", None, None]
    written = ["2024-01-15 00:00:00", "2024-01-15T10:20:30.5Z", "2024-01-15 10:20:30+05:30", "15/01/2024", "15-01-2024 9:05",
               " 2024/01/15 ", "01/15/2024", "15.01.2024", "2024-01-15 noon"]
    assert apply(spark, written, lambda c: dates.parse_date(c).cast("string")) == ["2024-01-15"] * 6 + [None] * 3
    assert apply(spark, ["01/15/2024"], lambda c: dates.parse_date(c, ("MM/dd/yyyy",)).cast("string")) == ["2024-01-15"]
    assert apply(spark, ["FY1999", "x2015y", "none"], lambda c: dates.digits_year(c, r"(20[0-9]{2})")) == [
        None, 2015, None]


@pytest.mark.parametrize("grain", ["month", "day"])
def test_period_axis_round_trip(spark, grain):
    days = ["1969-12-01", "1970-01-01", "1999-12-01", "2000-01-01", "2024-02-01"]
    found = apply(spark, days, lambda c: dates.period_date(
        dates.period_index(c.cast("date"), grain), grain).cast("string"))
    assert found == days
    with pytest.raises(ValueError):
        dates.period_index(F.lit("2000-01-01"), "week")


FORMATS = {
    "%Y-%m-%d": "yyyy-M-d", "%Y-%-m-%-d": "yyyy-M-d", "%m/%d/%Y": "M/d/yyyy", "%-m/%-d/%Y": "M/d/yyyy", "%m-%d-%Y": "M-d-yyyy",
    "%d-%b-%Y": "d-MMM-yyyy", "%d %b %Y": "d MMM yyyy", "%B %d, %Y": "MMMM d, yyyy", "%b %Y": "MMM yyyy", "%Y/%m/%d": "yyyy/M/d",
    "%Y%m%d": "yyyyMMdd", "%Y-%m": "yyyy-M", "%b %d, %Y": "MMM d, yyyy"}


@pytest.mark.parametrize("written", FORMATS)
def test_inferred_dates_equal_those_of_pandas(spark, written):
    days = pd.date_range("2023-11-20", periods=60, freq="9D")
    texts = [d.strftime(written) for d in days] + ["no date", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    assert dates.infer_formats(frame, F.col("d")) == (FORMATS[written],)
    found = [r[0] for r in frame.orderBy("i").select(dates.parse_column(frame, "d")).collect()]
    expected = pd.to_datetime(pd.Series(texts), errors="coerce")
    assert found == [None if pd.isna(x) else x.date() for x in expected]
    assert found[-2:] == [None, None] and None not in found[:-2]


def test_day_and_month_are_told_by_the_column(spark):
    def read(*texts):
        frame = spark.createDataFrame([(t,) for t in texts], "d string")
        return [str(r[0]) for r in frame.select(dates.parse_column(frame, "d")).collect()]
    assert read("03/04/2024", "05/06/2024") == ["2024-03-04", "2024-05-06"]  # a tie: the month first, as pandas
    assert read("03/04/2024", "15/06/2024") == ["2024-04-03", "2024-06-15"]
    assert read("03/04/2024", "06/15/2024 10:30") == ["2024-03-04", "2024-06-15"]
    # Several formats: all that occur, but days and months are not exchanged within one of them.
    assert read("2024-01-05", "03/04/2024", "15/06/2024", "07-08-2024", "Jan 2024") == [
        "2024-01-05", "2024-04-03", "2024-06-15", "2024-07-08", "2024-01-01"]
    assert read("x", "", None) == ["None"] * 3
    frame = spark.createDataFrame([("03/04/2024",)], "d string")
    assert str(frame.select(dates.parse_column(frame, "d", ("dd/MM/yyyy",))).first()[0]) == "2024-04-03"
