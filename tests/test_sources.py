"""Column names, readers, layouts and sinks."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from uptake.functions import numeric
from uptake.operators import rows
from uptake.plans import preparation, reports, sheets
from uptake.plans.variants import BATCH, DASHBOARD, DEFAULT
from uptake.sources import columns, readers, sinks


def test_unique_and_clean_names():
    assert columns.unique_names(["x", " x", "x", "y", 3]) == ["x", "x_1", "x_2", "y", "3"]
    assert columns.clean_names(["Sl. No.", "State/ UT", "% of Share-x", "State/ UT"]) == [
        "Sl_No", "State__UT", "Percent_of_Share_x", "State__UT_1"]


def test_column_discovery():
    names = ["Sl_No", "Fin_Year", "Month", "Electric_2W", "Electric_Total", "Total_Registration"]
    assert columns.find_column(names, ["year", "month"]) == "Fin_Year"
    assert columns.find_column(names, ["date"]) is None
    assert columns.category_columns(names, ["Fin_Year"]) == ["Electric_2W"]
    assert columns.year_columns(["FY2015", "FY15", "FY2015x", "a"]) == ["FY2015"]
    assert columns.year_columns(["FY2015", "FY15", "a"], strict=False) == ["FY2015", "FY15"]
    with pytest.raises(ValueError, match="date.*state"):
        columns.require({"date": None, "state": None, "fuel": "f"}, "table")


def test_read_csv_keeps_text_and_marks_missing(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n001,NA\n,x\nN/A,1.50\n")
    assert values(readers.read_table(spark, path)) == [("001", None), (None, "x"), (None, "1.50")]
    dotted = tmp_path / "b.csv"
    dotted.write_text('Sl. No.,State/ UT,Total EV,Sold,% of Share\n1,Goa,"1,0",40,25\n2,Sikkim,NA,8,0\nTotal,Total,10,48,x\n')
    table = rows.drop_totals(columns.with_clean_columns(readers.read_csv(spark, str(dotted))))
    assert table.columns == ["Sl_No", "State__UT", "Total_EV", "Sold", "Percent_of_Share"]
    counts = table.select("State__UT", *[
        numeric.as_number(table, name).alias(name) for name in ("Total_EV", "Sold")])
    shares = reports.share_table(counts, "State__UT", "Total_EV", "Sold")
    assert dict(values(shares, "State__UT", "Share_Percent")) == {"Goa": 25.0, "Sikkim": None}
    frame = spark.range(1)
    assert readers.read_table(spark, frame) is frame


def test_monthly_table_from_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "Year,Month,Electric 2W,Electric Two Wheel,Electric 4W,Total Registration\n"
        '2015,Jan,"1,000",5,66,1071\n2015,Feb,-4,1,NA,-3\n2015,Feb,2,0,1,3\n'
        "2015,Sept,9,9,9,27\nTotal,,9,9,9,27\n"
    )
    monthly = preparation.monthly_categories(readers.read_csv(spark, str(path)))
    found = monthly.categories.select(
        F.col("Date").cast("string"), "Category", "EV_Registrations", "Month_Name"
    ).orderBy("Date", "Category")
    assert values(found) == [
        ("2015-01-01", "2W", 1005.0, "Jan"), ("2015-01-01", "Cars", 66.0, "Jan"),
        ("2015-02-01", "2W", 3.0, "Feb"), ("2015-02-01", "Cars", 1.0, "Feb"),
    ]
    totals = monthly.totals.select(F.col("Date").cast("string"), "EV_Registrations").orderBy("Date")
    assert values(totals) == [("2015-01-01", 1071.0), ("2015-02-01", 3.0)]
    # Without clipping the negative cell counts.
    signed = preparation.monthly_categories(readers.read_csv(spark, str(path)), BATCH).categories
    assert values(signed.where("Month = 2 AND Category = '2W'"), "EV_Registrations") == [(-1.0,)]


@pytest.mark.parametrize("pattern", ["{}-{:02d}-01 00:00:00", "15/{1:02d}/{0}"])
def test_state_rows_keep_other_date_formats(spark, pattern):
    rows = [(pattern.format(2024, m), "Goa", "EV", "1") for m in range(1, 13)] + [("someday", "Goa", "EV", "1")]
    found = preparation.state_months(spark.createDataFrame(rows, ["date", "state", "fuel", "registrations"]))
    assert sorted(values(found.electric, "Month", "EV_Registrations")) == [(m, 1.0) for m in range(1, 13)]
    assert values(found.unparsed) == [(13, 1)]


def test_monthly_table_errors(spark):
    with pytest.raises(ValueError, match="month"):
        preparation.monthly_categories(spark.createDataFrame([("1", "2")], "Year string, Electric string"))
    with pytest.raises(ValueError, match="electric"):
        preparation.monthly_categories(spark.createDataFrame([("1", "2")], "Date string, x string"))


def test_state_table(spark):
    raw = spark.createDataFrame([
        ("2021-01-05", "tamil  nadu", "Electric (BOV)", "1,000"),
        ("2021-01-05", "TAMIL NADU", " electric(bov)", "5"),
        ("2021-01-05", "Tamil Nadu", "Petrol", "-7"),
        ("2021-02-05", "Tamil Nadu", "Strong Hybrid EV", "9"),
        ("bad", "Tamil Nadu", "EV", "100"),
    ], ["date", "state name", "fuel.type", "Registrations"])
    table = raw.toDF("date", "state name", "fuel type", "Registrations")
    found = preparation.state_months(table)
    assert values(found.electric, "State", "Year", "Month", "EV_Registrations") == [
        ("Tamil Nadu", 2021, 1, 1005.0)]
    all_fuels = found.all_fuels.orderBy("Date")
    assert values(all_fuels, "Month", "Total_Registrations") == [(1, 1005.0), (2, 9.0)]
    assert found.rows.count() == 4
    assert values(found.rows.where("Is_EV").select("Fuel_Type").distinct().orderBy("Fuel_Type")) == [
        ("Electric (Bov)",), ("Electric(Bov)",)]
    trimmed = preparation.state_months(table, DASHBOARD).rows
    assert ("electric(bov)",) in values(trimmed, "Fuel_Type")
    with pytest.raises(ValueError, match="fuel"):
        preparation.state_months(table.drop("fuel type"))


def test_stacked_header_file(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text(
        "Old table\n,DIESEL,,ELECTRIC(BOV),,ELECTRIC(BOV)\nState,2019,2020,2019,2020,Remark\n"
        'tamil nadu,1,2,"3,000",NA,x\nTamil  Nadu,1,1,1,4,x\n,,,,,\nGrand Total,9,9,9,9,9\n'
        "nct of delhi,1,1,7,8,y\n"
    )
    grid = readers.read_grid(spark, str(path))
    found = sheets.stacked_header_to_long(grid).orderBy("State", "Year")
    assert values(found) == [
        ("Delhi", 2019, 7.0), ("Delhi", 2020, 8.0),
        ("Tamil Nadu", 2019, 3001.0), ("Tamil Nadu", 2020, 4.0),
    ]


def test_stacked_header_errors():
    with pytest.raises(ValueError, match="state header"):
        sheets.stacked_header([["a", "b"]])
    at, names = sheets.stacked_header([["", "EV", None], ["State", "2020", None]])
    assert (at, names) == (1, ["State", "EV_2020", "EV"])


@pytest.mark.parametrize("split", ["128m", "4096"])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    path = tmp_path / "long.csv"
    path.write_text("\n".join(["State,2020", *[f"s{i},{i}" for i in range(5000)]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        grid = readers.read_grid(spark, str(path))
        assert (grid.rdd.getNumPartitions() > 1) == (split == "4096")
        assert rows.row_band(grid, 0, 2000, readers.ROW_NO).count() == 2001
        assert rows.row_band(grid, 4000, None, readers.ROW_NO).count() == 1001
        cells = {r.row_no: r.c0 for r in grid.collect()}
        assert cells == {0: "State", **{i + 1: f"s{i}" for i in range(5000)}}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", ["128m", "2048"])
def test_a_written_grid_keeps_its_row_numbers(spark, tmp_path, split):
    grid = spark.range(4000).selectExpr("id * 7 % 4000 AS row_no", "concat('r', id * 7 % 4000) AS c0", "IF(id % 9 = 0, NULL, 'a, \"b\"') AS c1")
    path = str(tmp_path / "grid")
    sinks.write_grid(grid, path, readers.ROW_NO)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = readers.read_grid(spark, path)
        assert sorted(values(found, "row_no", "c0", "c1")) == sorted(values(grid, "row_no", "c0", "c1"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_rows_are_not_cut(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("".join(f"a{i},b,c\n" for i in range(9)) + "wide,1,2,3,4\n")
    with pytest.raises(Exception, match="more than 3 cells"):
        readers.read_grid(spark, str(path)).select("c0").collect()
    grid = readers.read_grid(spark, str(path), width=5)
    assert values(grid.where("row_no = 9")) == [("wide", "1", "2", "3", "4", 9)]
    (tmp_path / "more").mkdir()
    for name in ("b", "a", "c"):
        (tmp_path / "more" / name).write_text("" if name == "b" else f"{name},1\n{name},2\n")
    several = readers.read_grid(spark, str(tmp_path / "more"))
    assert sorted(values(several, "row_no", "c0", "c1")) == [(0, "a", "1"), (1, "a", "2"), (2, "c", "1"), (3, "c", "2")]
    (tmp_path / "short.csv").write_text("a,b\n1\n1,234,5\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        readers.read_csv(spark, str(tmp_path / "short.csv")).select("a").collect()
    (tmp_path / "short.csv").write_text("a,b\n1\n1,234\n")
    assert values(readers.read_csv(spark, str(tmp_path / "short.csv"))) == [("1", None), ("1", "234")]


@pytest.mark.parametrize("multi_line", [False, True])
def test_wide_rows_with_an_empty_first_surplus_cell_are_not_cut(spark, tmp_path, multi_line):
    path = str(tmp_path / "wide.csv")
    for row in ("1,2,,c", "1,,,c", ",,,c", "1,2,,,,c,", '"1,x","2",,"c,d"', "1,2,c", '1,"2""",,c'):
        (tmp_path / "wide.csv").write_text(f"a,b\n1\n1,2\n{row}\n")
        with pytest.raises(Exception, match="more than 2 cells"):
            readers.read_csv(spark, path, multi_line=multi_line).select("a").collect()
        with pytest.raises(Exception, match="more than 2 cells"):
            readers.read_csv(spark, path, multi_line=multi_line).count()
        (tmp_path / "wide.csv").write_text("title\n" + "a,b\n" * 9 + f"{row}\n")
        with pytest.raises(Exception, match="more than 2 cells"):
            readers.read_grid(spark, path, multi_line=multi_line).select("c0").collect()
    (tmp_path / "wide.csv").write_text('a,b\n1\n""\n1,2,,\n"x,y",\n"q,r"\n,2\n')
    found = readers.read_csv(spark, path, multi_line=multi_line)
    assert values(found) == [("1", None), (None, None), ("1", "2"), ("x,y", None), ("q,r", None), (None, "2")]
    assert found.count() == 6


def test_quoted_cells_read_as_the_csv_module_does(spark, tmp_path):
    import csv
    import random

    draw = random.Random(4)
    parts = ['"', ",", "x", "y z", '""', "7", "'", "\\", "é"]
    for multi_line in (False, True):
        pieces = parts + (["\n"] if multi_line else [])
        table = [["k", "a", "b"]] + [
            [str(i)] + ["c" + "".join(draw.choices(pieces, k=draw.randint(1, 6))) + "d" for _ in range(2)] for i in range(300)]
        path = tmp_path / f"quoted{multi_line}.csv"
        with open(path, "w", newline="") as file:
            csv.writer(file, lineterminator="\n").writerows(table)
        with open(path, newline="") as file:
            assert list(csv.reader(file)) == table
        found = readers.read_csv(spark, str(path), multi_line=multi_line)
        assert sorted(map(list, values(found))) == sorted(table[1:])
        grid = readers.read_grid(spark, str(path), width=3, multi_line=multi_line)
        assert [list(r) for r in values(grid.orderBy("row_no"), "c0", "c1", "c2")] == table


def _sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        ",,FY2015,FY2016,Note\n"
        "India,Total,100,200,\nIndia,EV,10,\"2,0\",\nIndia,Petrol,50,NA,\nIndia,,1,1,\n"
        "x,y,9,9,\nx,y,9,9,\nCategory,Fuel,FY2015,FY2016,\n"
        "Two Wheeler (T),EV,1,2,\nTwo Wheeler (NT),EV,3,4,\nMotor Car,  total ,5,6,\n"
        ",EV,7,7,\nSource: x,EV,8,8,\n"
    )
    grid = readers.read_grid(spark, str(path))
    return sheets.promote_header(grid)


def test_sheet_bands_from_file(spark, tmp_path):
    sheet = _sheet(spark, tmp_path)
    assert sheet.columns == ["Unnamed: 0", "Unnamed: 1", "FY2015", "FY2016", "Note", "row_no"]
    long = sheets.bands_to_long(sheet, ("Unnamed: 0", "Unnamed: 1"))
    found = {(c, f, y): v for c, f, y, v in values(long, "Category", "Fuel_Type", "Year", "Registrations")}
    assert found == {
        ("All Vehicles", "Total", 2015): 100.0, ("All Vehicles", "Total", 2016): 200.0,
        ("All Vehicles", "Ev", 2015): 10.0, ("All Vehicles", "Ev", 2016): 20.0,
        ("All Vehicles", "Petrol", 2015): 50.0, ("All Vehicles", "Petrol", 2016): 0.0,
        ("All Vehicles", None, 2015): 1.0, ("All Vehicles", None, 2016): 1.0,
        ("2W", "Ev", 2015): 4.0, ("2W", "Ev", 2016): 6.0,
        ("Cars", "Total", 2015): 5.0, ("Cars", "Total", 2016): 6.0,
    }
    assert {r for r in values(long.where("Is_EV"), "Fuel_Type")} == {("Ev",)}


def test_sheet_bands_variants(spark, tmp_path):
    sheet = _sheet(spark, tmp_path)
    labels = ("Unnamed: 0", "Unnamed: 1")
    plain = sheets.bands_to_long(sheet, labels, BATCH)
    # No footer filter, no label rules, no merging: both wheeler rows and the footers stay.
    assert {r[0] for r in values(plain, "Category")} == {
        "All Vehicles", "Two Wheeler (T)", "Two Wheeler (NT)", "Motor Car", "Source: x"}
    board = sheets.bands_to_long(sheet, labels, DASHBOARD).where("Category = '2W'")
    assert board.count() == 4
    with pytest.raises(ValueError, match="year"):
        sheets.bands_to_long(sheet.drop("FY2015", "FY2016"), labels, DEFAULT)


def test_drop_totals(spark):
    nbsp, zwsp = chr(0xA0), chr(0x200B)
    frame = spark.createDataFrame([
        ("a", "x", 1), (" TOTAL ", "x", 2), ("a", f"grand{nbsp}total", 3), (f"to{zwsp}tal", None, 4),
        (None, None, 5), ("subtotal", "total x", 6),
    ], "a string, `b c` string, n int")
    assert values(rows.drop_totals(frame), "n") == [(1,), (5,), (6,)]
    numbers = frame.select("n")
    assert rows.drop_totals(numbers) is numbers


def test_row_filters(spark):
    frame = spark.createDataFrame([("Source: a", 1), ("CATEGORY", 2), (None, 3), ("x", None), (None, None)],
                                  "a string, n int")
    assert rows.exclude_matching(frame, "a", "source|category").count() == 3
    assert rows.drop_empty_rows(frame).count() == 4
    assert rows.drop_missing(frame, ["a", "n"]).count() == 2
    wanted = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert values(rows.keep_members(frame, "n", wanted).orderBy("n"), "n") == [(1,), (3,)]


def test_sinks_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("a", 2015, 1.5), ("b", 2016, None)], "k string, Year int, v double")
    paths = sinks.write_outputs({"one": frame, "two": frame}, str(tmp_path / "out"), {"two": ("Year",)})
    assert sorted(values(readers.read_csv(spark, paths[0]))) == [("a", "2015", "1.5"), ("b", "2016", None)]
    assert (tmp_path / "out" / "two" / "Year=2015").exists()
    sinks.write_parquet(frame, str(tmp_path / "p"), ("Year",))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(values(back, "k", "Year", "v"), key=str) == [("a", 2015, 1.5), ("b", 2016, None)]
