"""Facts derived from the driver's tables, and the same facts as SQL for the oracles.

Orders play the registrations: the customer's nation is the state, the market segment the fuel, the
order priority the category, and an order counts as one registration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uptake.functions.labels import ALL_VEHICLES, is_ev_fuel
from uptake.functions.numeric import total
from uptake.operators.matching import join_dimension

# The fuel each market segment stands for; another segment stands for itself.
FUELS = {
    "AUTOMOBILE": "ELECTRIC(BOV)",
    "BUILDING": "PETROL",
    "FURNITURE": "DIESEL",
    "HOUSEHOLD": "PETROL/CNG",
    "MACHINERY": "STRONG HYBRID EV",
}

YEARS = list(range(1995, 2002))
START_YEAR, END_YEAR = 1995, 2000
HORIZON = 2005

# The wide columns of the monthly table and the category each is filled from.
WIDE = {
    "Electric 2W": "1-URGENT",
    "Electric 3W": "2-HIGH",
    "Electric 4W": "3-MEDIUM",
    "Electric Goods": "4-NOT SPECIFIED",
    "Electric Bus": "5-LOW",
}


# The tables' schemas. Given to the reader, they save a job that opens footers.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
                " c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
                " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
            " p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
              " props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def month_of(column: str) -> Column:
    return F.trunc(F.col(column), "MM")


def _fuel(segment: Column) -> Column:
    names = F.create_map(*[F.lit(part) for pair in FUELS.items() for part in pair])
    return F.coalesce(F.try_element_at(names, segment), segment)


def by_nation(spark: SparkSession, sf: str, fact: DataFrame, keep, sums) -> DataFrame:
    """Sum a fact keyed by customer (column ``c_custkey``) per nation, fuel and kept columns.

    The nation name joins last, onto the few summed rows.
    """
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    placed = join_dimension(fact, customer, "c_custkey", keep, sums)
    per_nation = placed.groupBy("c_nationkey", "c_mktsegment", *keep).agg(
        *[total(F.col(name)).alias(name) for name in sums]
    )
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("State")
    )
    return per_nation.join(nation, "c_nationkey").select(
        "State", _fuel(F.col("c_mktsegment")).alias("Fuel_Type"), *keep, *sums
    )


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """State, Fuel_Type, Category, Date, Registrations, Is_EV: one row per combination."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        month_of("o_orderdate").alias("Date"),
        F.col("o_orderpriority").alias("Category"),
        F.lit(1.0).alias("Registrations"),
    )
    reg = by_nation(spark, sf, orders, ["Date", "Category"], ["Registrations"])
    return reg.withColumn("Is_EV", is_ev_fuel(F.col("Fuel_Type")))


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly long fact with All Vehicles and Total rows, built on the summed registrations."""
    reg = registrations(spark, sf)
    base = reg.groupBy("Category", "Fuel_Type", F.year("Date").alias("Year")).agg(
        F.sum("Registrations").alias("Registrations")
    )
    spread = base.withColumn(
        "Category", F.explode(F.array(F.lit(ALL_VEHICLES), F.col("Category")))
    ).withColumn("Fuel_Type", F.explode(F.array(F.lit("Total"), F.col("Fuel_Type"))))
    summed = spread.groupBy("Category", "Fuel_Type", "Year").agg(
        F.sum("Registrations").alias("Registrations")
    )
    return summed.withColumn("Is_EV", is_ev_fuel(F.col("Fuel_Type")))


def ev_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The electric registrations as forecast input: State, Category, Date, EV_Registrations."""
    return registrations(spark, sf).where("Is_EV").withColumnRenamed(
        "Registrations", "EV_Registrations"
    )


def state_ev(spark: SparkSession, sf: str) -> DataFrame:
    """State, Date, Year, Month, EV_Registrations."""
    ev = registrations(spark, sf).where("Is_EV")
    return ev.groupBy("State", "Date").agg(
        F.sum("Registrations").alias("EV_Registrations")
    ).withColumns({"Year": F.year("Date"), "Month": F.month("Date")})


def category_ev(spark: SparkSession, sf: str) -> DataFrame:
    """Category, Date, Year, Month, EV_Registrations."""
    ev = registrations(spark, sf).where("Is_EV")
    return ev.groupBy("Category", "Date").agg(
        F.sum("Registrations").alias("EV_Registrations")
    ).withColumns({"Year": F.year("Date"), "Month": F.month("Date")})


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as forecast input: Date, EV_Registrations."""
    return table(spark, sf, "orders").select(
        month_of("o_orderdate").alias("Date"), F.lit(1.0).alias("EV_Registrations")
    )


def monthly_total(spark: SparkSession, sf: str) -> DataFrame:
    """Date, Year, Month, EV_Registrations of all orders: one table, no join."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(month_of("o_orderdate").alias("Date")).agg(
        F.count("*").cast("double").alias("EV_Registrations")
    ).withColumns({"Year": F.year("Date"), "Month": F.month("Date")})


def wide_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A dirty wide monthly table as it would come from a file: text cells, a totals row."""
    orders = table(spark, sf, "orders")
    cells = [
        F.count_if(F.col("o_orderpriority") == priority).alias(name)
        for name, priority in WIDE.items()
    ]
    names = [*WIDE, "Total Registration"]
    counts = orders.groupBy(month_of("o_orderdate").alias("d")).agg(
        *cells, F.count("*").alias("Total Registration")
    )
    # Each summed month also counts towards the totals row, whose date is NULL.
    both = counts.withColumn("d", F.explode(F.array(F.col("d"), F.lit(None))))
    summed = both.groupBy("d").agg(*[F.sum(name).alias(name) for name in names])
    return summed.selectExpr(
        "CASE WHEN d IS NULL THEN ' Grand Total' ELSE concat('FY', year(d)) END AS Year",
        "concat(' ', upper(date_format(d, 'MMM'))) AS Month",
        *[f"concat(' ', format_number(`{name}`, 0)) AS `{name}`" for name in names],
    )


# ---- the same facts for the oracles --------------------------------------------------------

def _fuel_sql() -> str:
    cases = " ".join(f"WHEN '{seg}' THEN '{fuel}'" for seg, fuel in FUELS.items())
    return f"CASE c_mktsegment {cases} ELSE c_mktsegment END"


REG = f"""reg AS (
  SELECT n_name AS State, {_fuel_sql()} AS Fuel_Type, o_orderpriority AS Category,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS Date,
         CAST(count(*) AS DOUBLE) AS Registrations, c_mktsegment = 'AUTOMOBILE' AS Is_EV
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

YEARLY = f"""{REG}, yearly AS (
  SELECT coalesce(Category, 'All Vehicles') AS Category, coalesce(Fuel_Type, 'Total') AS Fuel_Type,
         y AS Year, sum(Registrations) AS Registrations,
         coalesce(Fuel_Type, 'Total') = 'ELECTRIC(BOV)' AS Is_EV
  FROM (SELECT *, CAST(year(Date) AS INTEGER) AS y FROM reg)
  GROUP BY GROUPING SETS ((Category, Fuel_Type, y), (Category, y), (Fuel_Type, y), (y)))"""

PARTS = "CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month"

STATE_EV = f"""{REG}, state_ev AS (
  SELECT State, Date, {PARTS}, sum(Registrations) AS EV_Registrations
  FROM reg WHERE Is_EV GROUP BY ALL)"""

CATEGORY_EV = f"""{REG}, category_ev AS (
  SELECT Category, Date, {PARTS}, sum(Registrations) AS EV_Registrations
  FROM reg WHERE Is_EV GROUP BY ALL)"""

MONTHLY = f"""monthly AS (
  SELECT Date, {PARTS}, n AS EV_Registrations FROM (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Date, CAST(count(*) AS DOUBLE) AS n
    FROM orders GROUP BY 1))"""


def r4(expression: str) -> str:
    """Round like ``registry.rounded``."""
    return f"round({expression}, 4) + 0.0"
