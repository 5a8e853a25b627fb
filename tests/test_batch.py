"""The whole batch job from files to files."""

from uptake.plans import batch
from uptake.plans.variants import DEFAULT
from uptake.sources.readers import read_csv


def _inputs(tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(
        ",,FY2015,FY2016\nIndia,Total,100,200\nIndia,EV,10,20\nIndia,Petrol,5,5\nIndia,Diesel,1,1\n"
        "x,y,,\nx,y,,\nCategory,Fuel,FY2015,FY2016\n2W,EV,1,4\n2W,Total,10,16\n"
    )
    state = tmp_path / "state.csv"
    months = [f"20{20 + m // 12}-{m % 12 + 1:02d}-01" for m in range(24)]
    state.write_text("date,state_name,fuel_type,registrations\n" + "".join(
        f"{month},{name},ELECTRIC(BOV),{100 + i}\n{month},{name},PETROL,9\n"
        for i, month in enumerate(months) for name in ("goa", "nct of delhi")
    ))
    reference = tmp_path / "reference.csv"
    reference.write_text(",ELECTRIC(BOV),\nState,2020,2021\nGoa,12660,1434\n")
    return str(sheet), str(state), str(reference)


def test_batch_job(spark, tmp_path):
    sheet, state, reference = _inputs(tmp_path)
    out = str(tmp_path / "out")
    paths = batch.run(spark, sheet, state, out, years=(2015, 2016), end=2023)
    assert [p[len(out) + 1:] for p in paths] == [
        "cleaned/wheel_fuel_yearly_cleaned", "cleaned/penetration_cleaned",
        "cleaned/category_cagr_2015_2016", "cleaned/state_monthly_ev_cleaned",
        "state_forecast_monthly_2023", "state_forecast_2023_summary",
    ]
    growth = read_csv(spark, paths[2]).first()
    assert (growth.Category, float(growth.CAGR_Percent)) == ("2W", 300.0)
    assert read_csv(spark, paths[4]).count() == 2 * 48
    summary = read_csv(spark, paths[5])
    assert sorted(r.State for r in summary.collect()) == ["Delhi", "Goa"]


def test_batch_job_with_adjustment(spark, tmp_path):
    sheet, state, reference = _inputs(tmp_path)
    paths = batch.run(
        spark, sheet, state, str(tmp_path / "out"), reference, (2015, 2016), 2023, DEFAULT)
    monthly = read_csv(spark, paths[3])
    goa = monthly.where("State = 'Goa' AND Year = '2020'").selectExpr(
        "sum(CAST(EV_Registrations_Adjusted AS DOUBLE))").first()[0]
    assert round(goa, 6) == 12660
    actual = read_csv(spark, paths[4]).where("State = 'Goa' AND Year = '2020'").selectExpr(
        "sum(CAST(Actual AS DOUBLE))").first()[0]
    assert round(actual, 6) == 12660


def test_raw_rows_are_read_once(spark, tmp_path):
    """Without a checkpoint folder; the accumulator counts the rows of the state table that Spark reads."""
    sheet, state, reference = _inputs(tmp_path)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    raw = read_csv(spark, state)
    table = raw.mapInArrow(count, raw.schema)
    batch.run(spark, sheet, table, str(tmp_path / "out"), reference, (2015, 2016), 2023, DEFAULT)
    assert read.value == 96
    assert (tmp_path / "out" / "parquet" / "state_monthly_ev" / "Year=2020").exists()
