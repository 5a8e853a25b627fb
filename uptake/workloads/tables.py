"""Queries that go through sources, sinks and the preparation of raw tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from uptake.plans import preparation, reports, sheets
from uptake.sources import readers, sinks
from uptake.workloads import adoption, facts
from uptake.workloads.registry import ORACLES, query, rounded


def _folder(spark) -> str:
    application = spark.sparkContext.applicationId
    return f"{sinks.shared_folder(spark)}/{application}/{uuid.uuid4().hex}"


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'a "' || o_orderpriority || '", b' AS Label,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS Status FROM orders""")
def csv_round_trip(spark, sf):
    """Cells with quotes and commas, and missing ones, written as CSV and read again as text."""
    orders = facts.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit('a "'), "o_orderpriority", F.lit('", b')).alias("Label"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("Status"),
    )
    path = f"{_folder(spark)}/orders.csv"
    sinks.write_csv(orders, path)
    return readers.read_table(spark, path)


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, o_orderpriority AS Category, count(*) AS Rows FROM orders
WHERE year(o_orderdate) IN (1996, 1998) GROUP BY ALL""")
def parquet_by_year(spark, sf):
    """Orders written as Parquet by year; only the folders of two years are read again."""
    orders = facts.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("Year"), F.col("o_orderpriority").alias("Category"))
    path = f"{_folder(spark)}/orders"
    sinks.write_parquet(orders, path, ("Year",))
    years = readers.read_table(spark, path).where(F.col("Year").isin(1996, 1998))
    return years.groupBy("Year", "Category").agg(F.count("*").alias("Rows"))


@query(ORACLES["two_row_header_long"])
def two_row_header_file(spark, sf):
    """The reference table written as headerless CSV files, read back as a grid and turned long."""
    path = f"{_folder(spark)}/reference.csv"
    sinks.write_grid(adoption.stacked_grid(spark, sf), path, readers.ROW_NO)
    return sheets.stacked_header_to_long(readers.read_grid(spark, path))


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, 'line "' || o_orderkey || '", x' AS Label
FROM orders""")
def grid_row_numbers(spark, sf):
    """Row numbers of a grid of several files, in the order it was written."""
    orders = facts.table(spark, sf, "orders")
    label = F.concat(F.lit('line "'), F.col("o_orderkey"), F.lit('", x'))
    path = f"{_folder(spark)}/grid.csv"
    sinks.write_grid(orders.select("o_orderkey", label.alias("Label")).repartition(4).withColumn(
        "at", F.col("o_orderkey")), path, "at")
    grid = readers.read_grid(spark, path)
    return grid.select(F.col("c0").cast("long").alias("o_orderkey"), "row_no", F.col("c1").alias("Label"))


# Six ways to write a date; every tenth of the last is none.
_WRITTEN = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")


def _state_table(spark, sf):
    """Orders as a raw state table with awkward column names and mixed dates."""
    key = F.col("o_orderkey")
    text = F.lit("no date")
    for number, pattern in enumerate(_WRITTEN):
        text = F.when((key % 6 == number) & (key % 60 != 5), F.date_format("o_orderdate", pattern)).otherwise(text)
    raw = facts.table(spark, sf, "orders").select(
        text, F.when(key % 2 == 0, "tamil  nadu").otherwise("GOA"),
        F.when(F.col("o_orderstatus") == "F", "Electric (BOV)").otherwise("Petrol"), F.lit("1"))
    return readers.read_table(spark, raw.toDF("Report Date", "State/Name", "FUEL-type", "No. of Registrations"))


_DATED = "o_orderkey % 60 <> 5"


@query(f"""
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Tamil Nadu' ELSE 'Goa' END AS State, CAST(o_orderdate AS DATE) AS Date,
  CAST(year(o_orderdate) AS INTEGER) AS Year, CAST(month(o_orderdate) AS INTEGER) AS Month,
  CAST(count(*) AS DOUBLE) AS EV_Registrations
FROM orders WHERE o_orderstatus = 'F' AND {_DATED} GROUP BY 1, 2, 3, 4""")
def state_monthly_formats(spark, sf):
    """Electric rows of a table whose dates are written in six ways, columns found by keyword."""
    return preparation.state_months(_state_table(spark, sf)).electric


@query(f"SELECT count(*) AS Rows, count(*) FILTER (NOT ({_DATED})) AS Unparsed_Dates FROM orders")
def state_dates_unparsed(spark, sf):
    """How many rows of that table are left out for their date."""
    return preparation.state_months(_state_table(spark, sf)).unparsed


def _one_format(spark, sf, pattern):
    """Orders as a raw state table whose dates are written in one way."""
    key = F.col("o_orderkey")
    raw = facts.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", pattern), F.when(key % 3 == 0, " tamil nadu").otherwise("goa "),
        F.when(F.col("o_orderstatus") == "F", "EV").otherwise("Diesel"), (key % 5).cast("string"))
    return raw.toDF("Date", "State", "Fuel", "Registrations")


_ONE_FORMAT = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Tamil Nadu' ELSE 'Goa' END AS State, CAST({day} AS DATE) AS Date,
  CAST(year(o_orderdate) AS INTEGER) AS Year, CAST(month(o_orderdate) AS INTEGER) AS Month,
  CAST(sum(o_orderkey % 5) AS DOUBLE) AS EV_Registrations
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3, 4"""


@query(_ONE_FORMAT.format(day="o_orderdate"))
def state_monthly_month_first(spark, sf):
    """Electric rows of a table whose dates are written month first, as the column itself tells."""
    return preparation.state_months(_one_format(spark, sf, "MM/dd/yyyy")).electric


@query(_ONE_FORMAT.format(day="date_trunc('month', o_orderdate)"))
def state_monthly_month_names(spark, sf):
    """Electric rows of a table whose dates are months by name."""
    return preparation.state_months(_one_format(spark, sf, "MMM yyyy")).electric


@query("""
SELECT f.Format, count(*) AS Rows, 0::BIGINT AS Unparsed_Dates
FROM orders, (VALUES ('MM/dd/yyyy'), ('MMM yyyy'), ('d-MMM-yyyy'), ('yyyy-M-d')) f(Format) GROUP BY ALL""")
def inferred_dates_unparsed(spark, sf):
    """Rows left out for their date in tables of four formats."""
    found = [
        preparation.state_months(_one_format(spark, sf, pattern)).unparsed.select(F.lit(pattern).alias("Format"), "*")
        for pattern in ("MM/dd/yyyy", "MMM yyyy", "d-MMM-yyyy", "yyyy-M-d")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(f"""
SELECT c_nationkey AS State, sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END)::BIGINT AS Total_EV,
  count(*) AS Sold, {facts.r4("100.0 * sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END) / count(*)")}
  AS Share_Percent FROM customer GROUP BY 1""")
def state_share(spark, sf):
    """Share of electric customers per nation, from the two counts of each row."""
    customers = facts.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("State"), F.lit(1).alias("Sold"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", 1).otherwise(0).alias("Total_EV"))
    return rounded(reports.share_table(customers, "State", "Total_EV", "Sold"))
