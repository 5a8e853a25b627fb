"""Joins: outer merges with fill, lookups, and dimension joins on keys that may be hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.functions.numeric import total


def merge_sums(keys, **sides: tuple[DataFrame, str]) -> DataFrame:
    """Full outer merge of grouped sums, absent sides as 0.

    Each side is ``alias=(frame, value column)``. The sides are stacked and summed once, so one
    shuffle replaces the two of an outer join, partial sums leave the map side whatever the skew,
    and NULL keys match each other.
    """
    def lane(name, frame, value):
        blanks = {other: F.lit(None).cast("double") for other in sides if other != name}
        return frame.select(*keys, F.col(value).cast("double").alias(name)).withColumns(blanks)

    lanes = [lane(name, frame, value) for name, (frame, value) in sides.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), lanes)
    return stacked.groupBy(*keys).agg(*[total(F.col(name)).alias(name) for name in sides])


def left_fill(left: DataFrame, right: DataFrame, on, fill: dict) -> DataFrame:
    """Left join; the given columns of the right side are filled where it had no row. NULLs that
    a side brings along stay."""
    joined = left.join(right.withColumn("__met", F.lit(True)), list(on), "left")
    filled = {
        name: F.when(F.col("__met").isNull(), F.lit(value)).otherwise(F.col(name)) for name, value in fill.items()
    }
    return joined.withColumns(filled).drop("__met")


def inner_pair(left: DataFrame, right: DataFrame, on, value: str, names) -> DataFrame:
    """Inner join of one value column from each side under two names."""
    first, second = names
    return left.select(*on, F.col(value).alias(first)).join(
        right.select(*on, F.col(value).alias(second)), list(on), "inner"
    )


def join_dimension(fact: DataFrame, dimension: DataFrame, on: str, keep, sums) -> DataFrame:
    """Join the given columns of a fact to a dimension whose key is unique.

    The rows are the fact's, whatever the size of the dimension. Spark broadcasts a dimension below
    its threshold, so the fact is not shuffled; above it AQE splits the partition of a hot key.
    """
    return fact.select(on, *keep, *sums).join(dimension, on)
