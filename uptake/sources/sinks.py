"""Sinks. Each write is one distributed job; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder is chosen
    here only in local mode and where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def _arranged(df: DataFrame, partition_by):
    """Co-locate the rows of an output partition; AQE splits oversized and merges small ones."""
    if not partition_by:
        return df.write
    return df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)


def write_csv(df: DataFrame, path: str, partition_by=()) -> None:
    """CSV with a header; quotes in quoted cells are doubled, as ``readers.read_csv`` expects."""
    _arranged(df, partition_by).mode("overwrite").options(header=True, escape='"').csv(path)


def write_grid(df: DataFrame, path: str, row_no: str) -> None:
    """Headerless CSV of the other columns, in the order of ``row_no`` over the files in the order of their names:
    what ``readers.read_grid`` reads."""
    rows = df.orderBy(row_no).drop(row_no)
    rows.write.mode("overwrite").options(header=False, escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    _arranged(df, partition_by).mode("overwrite").parquet(path)


def write_outputs(frames: dict[str, DataFrame], directory: str, partition_by=None) -> list[str]:
    """Write named frames as CSV directories below ``directory`` and return their paths.

    ``partition_by`` maps a frame name to its partition columns.
    """
    layout = partition_by or {}
    paths = []
    for name, frame in frames.items():
        path = f"{directory.rstrip('/')}/{name}"
        write_csv(frame, path, layout.get(name, ()))
        paths.append(path)
    return paths
