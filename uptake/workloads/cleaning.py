"""Queries for scans, filters, column names, text, number, label and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from uptake.functions import dates, labels, numeric, text
from uptake.operators import reshape, rows
from uptake.sources.columns import find_column, with_clean_columns
from uptake.workloads.facts import REG, registrations, table
from uptake.workloads.registry import query, rounded

NBSP = chr(0xA0)
ZWSP = chr(0x200B)


@query("""
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000""")
def scan_project_filter(spark, sf):
    orders = table(spark, sf, "orders")
    kept = orders.where(
        (F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") == "1-URGENT")
        & (F.col("o_totalprice") > 100000)
    )
    return rounded(kept.select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS Year FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def range_filter(spark, sf):
    """Inclusive years, written as a date range so that it reaches the Parquet scan."""
    orders = table(spark, sf, "orders")
    in_range = (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1999-01-01")
    return orders.where(in_range).select("o_orderkey", F.year("o_orderdate").alias("Year"))


@query("""
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')""")
def isin_filter(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return rows.keep_members(orders, "o_orderpriority", ["1-URGENT", "3-MEDIUM"])


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def members_of_frame(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    owing = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    return rows.keep_members(orders, "o_custkey", owing)


@query("""
SELECT o_orderkey AS Order_Key, o_custkey AS Order_Key_1, o_orderstatus AS Status_Percent,
       o_orderpriority AS Sl_No_State_UT, CAST(o_orderdate AS DATE) AS Order_Date_
FROM orders""")
def column_clean_unique(spark, sf):
    """Awkward names cleaned and repeats numbered; the priority column is found by keyword."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate")
    )
    messy = orders.toDF("Order Key", " Order/Key", "Status %", "Sl. No./State-UT", "Order Date ")
    cleaned = with_clean_columns(messy)
    assert find_column(cleaned.columns, ["state", "status"]) == "Status_Percent"
    return cleaned.withColumnRenamed("Order_Date", "Order_Date_")


TOTAL_LABELS_SQL = """
  SELECT o_orderkey,
         CASE o_orderpriority WHEN '1-URGENT' THEN ' Grand' || chr(160) || 'TOTAL '
              WHEN '2-HIGH' THEN 'to' || chr(8203) || 'tal'
              WHEN '3-MEDIUM' THEN 'total sum'
              ELSE o_orderpriority END AS Label, o_orderstatus
  FROM orders"""


@query(f"SELECT * FROM ({TOTAL_LABELS_SQL}) WHERE Label NOT LIKE ' Grand%' AND Label NOT LIKE 'to%tal'")
def remove_total_rows(spark, sf):
    orders = table(spark, sf, "orders")
    priority = F.col("o_orderpriority")
    label = (
        F.when(priority == "1-URGENT", f" Grand{NBSP}TOTAL ")
        .when(priority == "2-HIGH", f"to{ZWSP}tal")
        .when(priority == "3-MEDIUM", "total sum").otherwise(priority)
    )
    return rows.drop_totals(orders.select("o_orderkey", label.alias("Label"), "o_orderstatus"))


@query("""
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS Status, o_orderpriority AS Priority
FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def drop_null_rows(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("Status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("Priority"),
    )
    return rows.drop_missing(orders, ["Status", "Priority"])


@query("""
SELECT nullif(o_orderstatus, 'P') AS Status, nullif(o_orderpriority, '5-LOW') AS Priority,
       count(*) AS n
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') GROUP BY ALL""")
def drop_all_null(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("Status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("Priority"),
    )
    return rows.drop_empty_rows(orders).groupBy("Status", "Priority").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS Label FROM orders
WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '1-URGENT')""")
def not_contains(spark, sf):
    """Rows whose label holds one of two words go; a NULL label stays."""
    label = F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("Label")
    orders = table(spark, sf, "orders").select("o_orderkey", label)
    return rows.exclude_matching(orders, "Label", "specified|urgent")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey <= 3 THEN 'national' ELSE 'category' END AS Band
FROM orders WHERE o_orderkey <= 3 OR o_orderkey >= 7""")
def positional_bands(spark, sf):
    """The order key serves as the explicit row number."""
    sheet = table(spark, sf, "orders").select("o_orderkey")
    top, rest = rows.in_band(0, 3, "o_orderkey"), rows.in_band(7, None, "o_orderkey")
    return sheet.where(top | rest).withColumn("Band", F.when(top, "national").otherwise("category"))


@query("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity
            WHEN l_returnflag = 'R' THEN NULL
            ELSE round(l_extendedprice, 2) END AS Amount
FROM lineitem""")
def clean_num(spark, sf):
    """Thousands separators, missing markers, white space, exponents and junk suffixes."""
    lineitem = table(spark, sf, "lineitem")
    price = F.concat(F.lit(f"{NBSP} "), F.format_number("l_extendedprice", 2), F.lit("\t"))
    dirty = (
        F.when(
            (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"),
            F.concat(F.lit("+"), F.col("l_quantity").cast("string"), F.lit("E0")),
        )
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), " NA ")
        .when(F.col("l_returnflag") == "R", F.concat(price, F.lit("d")))
        .otherwise(price)
    )
    return lineitem.select(
        "l_orderkey", "l_linenumber", numeric.clean_num(dirty).alias("Amount")
    )


TITLE_SQL = """array_to_string(list_transform(
    regexp_extract_all(lower({0}), '([\\p{{L}}]+|[^\\p{{L}}]+)'), 
    lambda v: CASE v[1] WHEN 'ß' THEN 'Ss' ELSE upper(v[1]) END || v[2:]), '')"""


@query(f"SELECT doc_id, {TITLE_SQL.format('text')} AS Title FROM documents")
def title_case(spark, sf):
    """Whole texts."""
    return table(spark, sf, "documents").select(
        "doc_id", text.title_case(F.col("text")).alias("Title")
    )


SPACE_SQL = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def squeeze_sql(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{SPACE_SQL}', ' ', 'g'))"


@query(f"SELECT page_id, {squeeze_sql('html')} AS Html FROM pages")
def whitespace_squeeze(spark, sf):
    """Whole pages."""
    return table(spark, sf, "pages").select("page_id", text.squeeze(F.col("html")).alias("Html"))


_STATE_TEXT = """CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN '  nct' || chr(160) || 'of  DELHI '
  WHEN 'BUILDING' THEN 'Jammu&Kashmir'
  WHEN 'FURNITURE' THEN 'Andaman &   Nicobar Island' || chr(9)
  ELSE n_name || chr(160) || '&' || lower(c_name) END"""


@query(f"""
WITH texts AS (SELECT c_custkey, {_STATE_TEXT} AS raw FROM customer
               JOIN nation ON c_nationkey = n_nationkey),
     tidy AS (SELECT c_custkey, {squeeze_sql("replace(raw, '&', ' and ')")} AS t FROM texts)
SELECT c_custkey, CASE lower(t) WHEN 'nct of delhi' THEN 'Delhi'
    WHEN 'andaman and nicobar island' THEN 'Andaman And Nicobar Islands'
    ELSE {TITLE_SQL.format('t')} END AS State FROM tidy""")
def state_name_normalize(spark, sf):
    raw = _state_text(spark, sf)
    return raw.select("c_custkey", labels.state_name(F.col("raw")).alias("State"))


@query(f"""
WITH texts AS (SELECT c_custkey, {_STATE_TEXT} AS raw FROM customer
               JOIN nation ON c_nationkey = n_nationkey),
     tidy AS (SELECT c_custkey, {squeeze_sql("replace(raw, '&', 'and')")} AS t FROM texts)
SELECT c_custkey, CASE lower(t) WHEN 'nct of delhi' THEN 'Delhi'
    WHEN 'andaman and nicobar island' THEN 'Andaman And Nicobar Islands'
    ELSE {TITLE_SQL.format('t')} END AS State FROM tidy""")
def state_name_joined(spark, sf):
    """The variant in which A&B reads as AandB."""
    raw = _state_text(spark, sf)
    return raw.select("c_custkey", labels.state_name(F.col("raw"), "joined").alias("State"))


def _state_text(spark, sf):
    segment = F.col("c_mktsegment")
    raw = (
        F.when(segment == "AUTOMOBILE", f"  nct{NBSP}of  DELHI ")
        .when(segment == "BUILDING", "Jammu&Kashmir")
        .when(segment == "FURNITURE", "Andaman &   Nicobar Island\t")
        .otherwise(F.concat("n_name", F.lit(f"{NBSP}&"), F.lower("c_name")))
    )
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", raw.alias("raw"))


_CLASS_SQL = """CASE p_type
  WHEN 'ECONOMY' THEN ' two Wheeler (NT)' WHEN 'SMALL' THEN 'Three Wheeler (Passenger) car'
  WHEN 'MEDIUM' THEN 'three wheeler (goods) 2w' WHEN 'PROMO' THEN p_name || ' Cargo'
  WHEN 'STANDARD' THEN 'HGV above 12 TONNES' ELSE p_name || '/x' END"""


@query(f"""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '2W' WHEN 'SMALL' THEN '3W Passenger'
    WHEN 'MEDIUM' THEN '3W Goods' WHEN 'PROMO' THEN 'Cars' WHEN 'STANDARD' THEN 'Goods Vehicles'
    ELSE {TITLE_SQL.format("p_name || '/x'")} END AS Category,
  CASE p_type WHEN 'ECONOMY' THEN '2W' WHEN 'SMALL' THEN 'Cars'
    WHEN 'MEDIUM' THEN 'Three Wheeler (Goods) 2W' WHEN 'PROMO' THEN 'Cars'
    WHEN 'STANDARD' THEN 'Goods Vehicles'
    ELSE {TITLE_SQL.format("p_name || '/x'")} END AS Category_No_Aliases
FROM part""")
def category_rules(spark, sf):
    kind, name = F.col("p_type"), F.col("p_name")
    raw = (
        F.when(kind == "ECONOMY", " two Wheeler (NT)")
        .when(kind == "SMALL", "Three Wheeler (Passenger) car")
        .when(kind == "MEDIUM", "three wheeler (goods) 2w")
        .when(kind == "PROMO", F.concat(name, F.lit(" Cargo")))
        .when(kind == "STANDARD", "HGV above 12 TONNES")
        .otherwise(F.concat(name, F.lit("/x")))
    )
    return table(spark, sf, "part").select(
        "p_partkey", labels.wheel_category(raw).alias("Category"),
        labels.wheel_category(raw, aliases=False).alias("Category_No_Aliases"),
    )


@query(f"""
WITH fuels AS (
  SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ' Electric  (BOV) '
    WHEN 'BUILDING' THEN 'elec tric' WHEN 'FURNITURE' THEN 'Strong Hybrid EV'
    WHEN 'HOUSEHOLD' THEN 'eV' ELSE 'petrol/' || lower(c_name) END AS f, c_mktsegment AS s
  FROM customer)
SELECT c_custkey, {TITLE_SQL.format(squeeze_sql('f'))} AS Fuel_Type,
       s IN ('AUTOMOBILE', 'HOUSEHOLD') AS Squeezed,
       s IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') AS Compact,
       s = 'HOUSEHOLD' AS Exact
FROM fuels""")
def fuel_is_ev(spark, sf):
    segment = F.col("c_mktsegment")
    raw = (
        F.when(segment == "AUTOMOBILE", " Electric  (BOV) ").when(segment == "BUILDING", "elec tric")
        .when(segment == "FURNITURE", "Strong Hybrid EV").when(segment == "HOUSEHOLD", "eV")
        .otherwise(F.concat(F.lit("petrol/"), F.lower("c_name")))
    )
    return table(spark, sf, "customer").select(
        "c_custkey", labels.fuel_label(raw).alias("Fuel_Type"),
        labels.is_ev_fuel(raw).alias("Squeezed"),
        labels.is_ev_fuel(raw, "compact").alias("Compact"),
        labels.is_ev_fuel(raw, "exact").alias("Exact"),
    )


@query(f"""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '2W' WHEN 'SMALL' THEN '3W'
    WHEN 'MEDIUM' THEN 'Cars' WHEN 'PROMO' THEN 'Goods Vehicles' WHEN 'STANDARD' THEN 'Buses'
    ELSE {TITLE_SQL.format("'electric ' || p_name")} END AS Category,
  CASE p_type WHEN 'ECONOMY' THEN 'Electric 2W' WHEN 'SMALL' THEN 'Electric 3W'
    WHEN 'MEDIUM' THEN 'Electric Cars' WHEN 'PROMO' THEN 'Electric Goods'
    WHEN 'STANDARD' THEN 'Electric Bus'
    ELSE {TITLE_SQL.format("'electric ' || p_name")} END AS Category_Prefixed
FROM part""")
def category_name_rules(spark, sf):
    kind = F.col("p_type")
    raw = (
        F.when(kind == "ECONOMY", "Electric_2W").when(kind == "SMALL", " ELECTRIC_Three_Wheel")
        .when(kind == "MEDIUM", "Electric_4_W").when(kind == "PROMO", "Electric_Goods")
        .when(kind == "STANDARD", "Mini_Bus_Electric")
        .otherwise(F.concat(F.lit("_electric_"), F.col("p_name")))
    )
    return table(spark, sf, "part").select(
        "p_partkey", labels.monthly_category(raw).alias("Category"),
        labels.monthly_category(raw, "prefixed").alias("Category_Prefixed"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND month(o_orderdate) = 9 THEN NULL
    WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN NULL
    ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS Date FROM orders""")
def parse_month_date(spark, sf):
    """Month names in any case; names that are not abbreviations, and missing ones, give NULL."""
    orders = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    short = F.date_format("o_orderdate", "MMM")
    month = (
        F.when((status == "P") & (F.month("o_orderdate") == 9), "Sept")
        .when((status == "F") & (F.col("o_orderpriority") == "5-LOW"), F.lit(None))
        .when(status == "O", F.upper(short)).otherwise(F.concat(F.lit(" "), F.lower(short)))
    )
    year = F.concat(F.lit("FY "), F.year("o_orderdate"), F.lit("*"))
    return orders.select("o_orderkey", dates.parse_year_month(year, month).alias("Date"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS Date
FROM orders""")
def parse_iso_date(spark, sf):
    """With the year-first format only, other dates are NULL."""
    orders = table(spark, sf, "orders")
    good = F.date_format("o_orderdate", "yyyy-MM-dd")
    bad = F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = F.when(F.col("o_orderstatus") == "P", bad).otherwise(good)
    return orders.select("o_orderkey", dates.parse_date(raw, dates.ISO_FORMATS).alias("Date"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS Date, CAST(year(o_orderdate) AS INTEGER) AS Year,
       CAST(month(o_orderdate) AS INTEGER) AS Month, strftime(o_orderdate, '%b') AS Month_Name,
       strftime(o_orderdate, '%b %Y') AS Month_Label
FROM orders""")
def date_parts(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("Date")
    )
    parts = dates.with_month_parts(orders)
    return parts.withColumn("Month_Label", dates.month_label(F.col("Date")))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS Year,
       CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INTEGER) END AS Year_20xx
FROM orders""")
def year_extract(spark, sf):
    label = F.concat(F.lit("FY"), F.year("o_orderdate"), F.lit("/x"))
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.digits_year(label).alias("Year"),
        dates.digits_year(label, r"(20[0-9]{2})").alias("Year_20xx"),
    )


@query(f"""
WITH {REG}, wide AS (SELECT State,
    sum(Registrations) FILTER (Category = '1-URGENT' AND Is_EV) AS Urgent,
    sum(Registrations) FILTER (Category = '2-HIGH' AND Is_EV) AS High,
    sum(Registrations) FILTER (Category = 'none') AS Empty FROM reg GROUP BY State)
SELECT State, 'Urgent' AS Category, Urgent AS Registrations FROM wide
UNION ALL SELECT State, 'High', High FROM wide
UNION ALL SELECT State, 'Empty', Empty FROM wide""")
def melt_wide(spark, sf):
    """Wide to long; cells without a value stay as NULL rows."""
    reg = registrations(spark, sf)

    def cell(category, name):
        hit = (F.col("Category") == category) & F.col("Is_EV")
        return F.sum(F.when(hit, F.col("Registrations"))).alias(name)

    wide = reg.groupBy("State").agg(
        cell("1-URGENT", "Urgent"), cell("2-HIGH", "High"), cell("none", "Empty")
    )
    return reshape.melt(wide, ["State"], ["Urgent", "High", "Empty"], "Category", "Registrations")


@query("""
SELECT 'orders' AS Source, CAST(year(o_orderdate) AS INTEGER) AS Year, count(*) AS n
FROM orders GROUP BY ALL
UNION ALL SELECT 'lineitem', CAST(year(l_shipdate) AS INTEGER), count(*) FROM lineitem GROUP BY ALL""")
def union_sources(spark, sf):
    def counted(name, date):
        counts = table(spark, sf, name).groupBy(F.year(date).alias("Year")).agg(
            F.count("*").alias("n")
        )
        return counts.withColumn("Source", F.lit(name))

    return reshape.stack(counted("orders", "o_orderdate"), counted("lineitem", "l_shipdate"))


@query("""
SELECT l_orderkey, l_linenumber, greatest(l_quantity - 25, 0) AS Clipped,
       CASE WHEN l_returnflag <> 'R' THEN greatest(l_quantity - 25, 0) END AS Clip_Only,
       CASE WHEN l_returnflag <> 'R' THEN greatest(l_quantity - 25, 0) ELSE 0 END AS Filled
FROM lineitem""")
def fill_and_clip(spark, sf):
    shifted = F.col("l_quantity") - 25
    gappy = F.when(F.col("l_returnflag") != "R", shifted)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numeric.clip_low(shifted).alias("Clipped"),
        numeric.clip_low(gappy).alias("Clip_Only"),
        numeric.fill_and_clip(gappy).alias("Filled"),
    )


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_linenumber - 1 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a - b) / nullif(b, 0) * 100, 4) + 0.0 AS Change,
       round(b / nullif(a, 0) * 100, 4) + 0.0 AS Share,
       CASE WHEN b > 0 THEN round((pow(a / b, 1.0 / 3) - 1) * 100, 4) + 0.0 END AS Cagr
FROM p""")
def growth_functions(spark, sf):
    """Percent change, share and CAGR, each with a base of 0 among its inputs."""
    now = F.col("l_quantity")
    before = F.col("l_linenumber").cast("double") - 1
    return rounded(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        numeric.pct_change(now, before).alias("Change"),
        numeric.share_percent(before, now).alias("Share"),
        numeric.cagr(before, now, 3).alias("Cagr"),
    ))
