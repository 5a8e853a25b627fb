"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm.chunks import written


_HOT = 100_000  # rows of one label that a task may well hold
_MOST_HOT = 100_000
_SALTS = 256


def _followed(rows: DataFrame, parent: DataFrame) -> DataFrame:
    """``rows`` (node, label) with each label replaced by that label's own in ``parent`` (node, label).

    A label that very many rows share is salted. There are at most ``_MOST_HOT`` of those, so their list is broadcast.
    """
    up = parent.select(F.col("node").alias("label"), F.col("label").alias("above"))
    total = rows.count()
    if total < _HOT:
        return rows.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    hot = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= max(_HOT, total // _MOST_HOT))
    hot = F.broadcast(written(hot.select("label", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    up = up.join(hot, "label", "left").select("label", "above", F.explode(salts).alias("salt"))
    found = rows.join(hot, "label", "left").select("node", "label", salt.alias("salt")).join(up, ["label", "salt"], "left")
    return found.select("node", F.coalesce("above", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Every round points each node to its smallest neighbour, follows the pointers a few steps and
    contracts the graph, until no edge is left; rounds grow with the logarithm of the longest path.
    Only minima are aggregated, so a node with very many edges costs partial minima per task.
    """
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = parent.select("node", F.least("node", "low").alias("label"))
        for _ in range(2):
            parent = written(parent)
            parent = _followed(parent, parent)
        parent = written(parent)
        rounds.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("label").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x != y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[0]
    for later in rounds[1:]:
        labels = written(_followed(labels, later))
    return labels
