"""Readers. Text tables are read as strings and cast only after cleaning."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ROW_NO = "row_no"
HEAD_LINES = 8
_RECORD = "__record"
_MARK = "\x1e"
_FILE, _BLOCK = "_metadata.file_path", "_metadata.file_block_start"
_QUOTES = {"quote": '"', "escape": '"'}  # a doubled quote in a quoted cell stands for one


def blank_missing(df: DataFrame) -> DataFrame:
    """Turn the missing markers in string columns into NULL."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = {name: F.col(f"`{name}`") for name in texts}
    kept = {name: F.when(~cell.isin(*MISSING), cell) for name, cell in cells.items()}
    return df.withColumns(kept) if kept else df


def _cells(spark: SparkSession, path: str, names, header: bool, multi_line: bool) -> DataFrame:
    """Text cells of a CSV under the given names; a row with a further cell that is not empty
    stops the query, whichever columns it reads."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _RECORD]])
    raw = spark.read.schema(schema).options(
        header=header, multiLine=multi_line, columnNameOfCorruptRecord=_RECORD, columnPruning=False, **_QUOTES).csv(path)
    # The parser keeps the record of rows with fewer or more cells. Empty cells at its end do not count; a
    # mark behind the others is among the first n + 1 cells if there are at most n.
    record, n = F.col(_RECORD), len(names)
    marked = F.concat(F.regexp_replace(record, ",+$", ""), F.lit("," + _MARK))
    cells = F.from_csv(marked, ", ".join(f"c{i} string" for i in range(n + 1)), _QUOTES)
    short = F.endswith(F.coalesce(*[cells[f"c{i}"] for i in reversed(range(n + 1))]), F.lit(_MARK))
    # Naming a cell too, since Spark refuses to read records alone.
    message = F.concat(F.lit(f"more than {n} cells in a row of {path} that begins with "), F.coalesce(f"`{names[0]}`", F.lit("''")), F.lit(": "), record)
    return raw.where(F.when(record.isNull() | F.coalesce(short, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def read_csv(spark: SparkSession, path: str, missing: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with a header row; every column arrives as text, so no inference pass over the data.

    A row may have fewer cells than the header (the rest is NULL), but not more. With ``multi_line``
    quoted cells may hold line breaks; Spark then reads each file in one task.
    """
    names = spark.read.options(header=True, multiLine=multi_line, **_QUOTES).csv(path).columns
    df = _cells(spark, path, names, True, multi_line).drop(_RECORD)
    return blank_missing(df) if missing else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, source) -> DataFrame:
    """A DataFrame as it is, a ``.csv`` path through the CSV reader, any other path as Parquet."""
    if isinstance(source, DataFrame):
        return source
    path = str(source)
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_parquet(spark, path)


def read_grid(spark: SparkSession, path: str, width: int | None = None, multi_line: bool = False) -> DataFrame:
    """Headerless CSV text as cells ``c0, c1, ...`` plus ``row_no``, counted from 0 over all files in the order of their names.

    The widest of the first lines gives the number of cells, since a title line may be short;
    ``width`` sets it for files with wider rows further down, which otherwise stop the query. A row's number is its
    place in its split plus the rows of all splits before; the latter is a table of one row per split, which is joined. So
    row numbers do not depend on how files are split. Sheets exported with their header
    row keep it as row 0. ``multi_line`` is as in ``read_csv``.
    """
    if width is None:
        lines = _first_lines(spark, path)
        width = max((len(cells) for cells in csv.reader([line + "\n" for line in lines])), default=1)
    cells = [f"c{i}" for i in range(width)]
    raw = _cells(spark, path, cells, False, multi_line)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = raw.select(*cells, within.alias("__within"), F.col(_FILE).alias("__file"), F.col(_BLOCK).alias("__block"))
    # A task may read several splits one after the other.
    splits = numbered.groupBy("__file", "__block").agg(F.min("__within").alias("__low"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low"))
    # One row per split, less than a millionth of the text.
    placed = numbered.join(F.broadcast(splits.select("__file", "__block", "__shift")), ["__file", "__block"])
    return blank_missing(placed.select(*cells, (F.col("__within") + F.col("__shift")).alias(ROW_NO)))


def _first_lines(spark: SparkSession, path: str) -> list[str]:
    """The first lines of the first file that has any, in the order of names."""
    for file in sorted(spark.read.text(path).inputFiles()):
        lines = [row.value for row in spark.read.text(file).limit(HEAD_LINES).collect()]
        if lines:
            return lines
    return []
