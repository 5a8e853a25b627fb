"""Plan shapes and skew: what has to hold when the tables are large."""

import re

import pytest
from conftest import values
from pyspark.sql import functions as F

import __spark_entry__ as contract
from uptake.operators import forecast as fc
from uptake.operators import matching
from uptake.workloads import facts

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df, kind="hashpartitioning") -> int:
    return len(re.findall(rf"Exchange {kind}", plan(df)))


def test_forecast_needs_two_shuffles_however_many_series(spark):
    rows = spark.range(1000).selectExpr(
        "id % 50 AS k", "add_months(DATE'2018-01-01', CAST(id % 40 AS INT)) AS Date",
        "1D AS EV_Registrations")
    scored = fc.score(rows, ["k"], end=2022)
    assert exchanges(fc.forecast_rows(scored, ["k"])) == 2
    # The metrics use the partitioning the rows already have.
    assert exchanges(fc.metrics(scored, ["k"])) == 2
    assert "Join" not in plan(fc.forecast_rows(scored, ["k"]))


def test_hot_key_forecast_is_right(spark):
    """One series holds most rows; its shuffle rows are bounded by the calendar."""
    rows = spark.range(60000).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 0 ELSE id % 97 END AS k",
        "add_months(DATE'2018-01-01', CAST(id % 41 AS INT)) AS Date", "1D AS EV_Registrations")
    scored = fc.score(rows, ["k"], end=2022)
    actual = fc.forecast_rows(scored, ["k"]).agg(F.sum("Actual")).first()[0]
    assert actual == 60000
    series = scored.where("Step >= 0 AND Actual IS NOT NULL").groupBy("k").count()
    assert series.agg(F.max("count")).first()[0] == 41


@pytest.fixture
def threshold(spark):
    """Sets the broadcast threshold for one test."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    yield lambda value: spark.conf.set(key, value)
    spark.conf.set(key, before)


def test_dimension_join_is_the_same_at_any_threshold(spark, threshold):
    fact = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 100 END AS c", "id % 4 AS m", "1D AS n", "id AS extra")
    dimension = spark.range(100).selectExpr("id AS c", "id % 5 AS g")
    found = {}
    for limit in ("10m", "-1"):
        threshold(limit)
        joined = matching.join_dimension(fact, dimension, "c", ["m"], ["n"])
        assert joined.columns == ["c", "m", "n", "g"]
        found[limit] = sorted(values(joined))
        assert ("SortMergeJoin" in plan(joined)) == (limit == "-1")
    assert found["10m"] == found["-1"] == sorted(values(fact.selectExpr("c", "m", "n", "c % 5 AS g")))


def test_facts_are_the_same_at_any_threshold(spark, threshold):
    names = ("State", "Fuel_Type", "Category", "Date", "Registrations")
    found = []
    for limit in ("10m", "-1"):
        threshold(limit)
        found.append(sorted(values(facts.registrations(spark, SF), *names)))
    assert found[0] == found[1]


ONCE = (
    "join_left_fill", "join_full_fill", "join_inner_suffixes", "join_chained_lookups", "join_left_fill_tables",
    "join_full_fill_tables", "join_inner_suffixes_tables", "positional_bands", "sheet_bands_to_long",
    "sheet_bands_raw_labels", "reconcile_compare", "reconcile_factors", "reconcile_adjust", "reconcile_forecast",
)


@pytest.mark.parametrize("name", ONCE)
def test_each_table_is_scanned_once(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    scans = re.findall(r"FileScan parquet .*?Location: InMemoryFileIndex\(1 paths\)\[[^\]]*?/(\w+)[.]parquet", text)
    assert scans and len(scans) == len(set(scans)), scans


def test_adjustment_joins_no_factors(spark):
    """The only joins are those of the tables: orders with lines, customers and nations."""
    assert plan(contract.queries()["reconcile_adjust"](spark, SF)).count("Join ") == 3


def test_filters_and_columns_reach_the_scan(spark):
    text = contract.queries()["range_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp\w*>", text)
    text = plan(contract.queries()["forecast_national"](spark, SF))
    assert re.search(r"ReadSchema: struct<o_orderdate:timestamp\w*>", text)


def test_top_k_is_not_a_full_sort(spark):
    text = plan(contract.queries()["state_annual_top10"](spark, SF))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
