"""Clusters around centroids with a table of pivot distances (LAESA), in exact whole numbers.

A few vectors are pivots. Each vector's distances to them are computed once and stored beside it. In every
round a task computes the distances from the pivots to the centroids; by the triangle inequality
the difference of two pivot distances bounds the distance between a vector and a centroid from below. The
centroid with the smallest bound is measured first, and only those whose bound does not exceed that
distance are measured too, with whole numbers. So results are the same as without pivots.

A round is one pass over the stored table that adds up the members of each centroid; sums travel as
limbs of 32 bits, which Spark adds map-side. The driver holds the centroids and pivots, nothing else.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm.chunks import written
from uptake.llm.integers import whole

_LIMB = 32
_SMALL = 1 << 24  # components below it: squared distances of up to 4096 components fit 64 bits


class Clusters(NamedTuple):
    rows: DataFrame
    centroids: list[list[int]]


def squared(rows, centre):
    """Exact squared distances of rows to one centre."""
    if rows.dtype != object and max(map(abs, centre), default=0) < _SMALL:
        gap = rows - np.array(centre, dtype=np.int64)
    else:
        gap = rows.astype(object) - np.array(centre, dtype=object)
    return (gap * gap).sum(axis=1) if gap.shape[1] else np.zeros(len(gap), dtype=np.int64)


def roots(distances):
    """Square roots as doubles; infinity for those beyond doubles."""
    if distances.dtype != object:
        return np.sqrt(distances.astype(np.float64))
    return np.array([float(math.isqrt(d)) if d.bit_length() < 2000 else math.inf for d in distances.tolist()], dtype=np.float64)


def lower_bounds(table, centres):
    """(rows, centres): the largest difference of pivot distances, less what rounding may add.
    Distances that are not finite bound nothing."""
    bound = np.zeros((len(table), len(centres)))
    for p in range(table.shape[1]):
        one, other = table[:, p, None], centres[None, :, p]
        with np.errstate(invalid="ignore"):
            difference = np.abs(one - other) - 1e-9 * (one + other) - 1
        np.fmax(bound, np.where(np.isfinite(difference), difference, 0), out=bound)
    return bound


def nearest(rows, bound, centroids):
    """(cluster, squared distance, number of distances computed): the nearest centroid of each row,
    ties to the smaller number."""
    at = np.arange(len(rows))
    cluster = bound.argmin(axis=1)
    distance = np.zeros(len(rows), dtype=object if rows.dtype == object else np.int64)
    for c in np.unique(cluster):
        mine = cluster == c
        found = squared(rows[mine], centroids[c])
        if found.dtype == object and distance.dtype != object:
            distance = distance.astype(object)
        distance[mine] = found
    first, reach, computed = cluster.copy(), roots(distance) * (1 + 1e-9) + 1, len(rows)
    for c, centre in enumerate(centroids):
        alive = at[(bound[:, c] <= reach) & (first != c)]
        if not len(alive):
            continue
        computed += len(alive)
        found = squared(rows[alive], centre)
        if found.dtype == object and distance.dtype != object:
            distance = distance.astype(object)
        better = (found < distance[alive]) | ((found == distance[alive]) & (c < cluster[alive]))
        moved = alive[better.astype(bool)]
        cluster[moved], distance[moved] = c, found[better.astype(bool)]
        reach[moved] = roots(distance[moved]) * (1 + 1e-9) + 1
    return cluster, distance, computed


def _matrix(column, width):
    """The rows of a binary column of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), width)


def _stored(pivots, dims, scale):
    def store(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            values = flat.reshape(batch.num_rows, dims)
            rows = whole(values, scale)
            table = np.empty((len(rows), len(pivots)))
            for p, pivot in enumerate(pivots):
                table[:, p] = roots(squared(rows, pivot))
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "vector": pa.array([v.tobytes() for v in values], pa.binary()),
                "pivots": pa.array([t.tobytes() for t in table], pa.binary())})
    return store


def _assigned(batch, dims, scale, pivots, centroids):
    centres = np.empty((len(centroids), len(pivots)))
    exact = np.empty((len(centroids), dims), dtype=object)
    exact[:] = centroids
    for p, pivot in enumerate(pivots):
        centres[:, p] = roots(squared(exact, pivot))
    rows = whole(_matrix(batch.column("vector"), dims), scale)
    bound = lower_bounds(_matrix(batch.column("pivots"), len(pivots)), centres)
    return rows, *nearest(rows, bound, centroids)[:2]


def limbs(number: int):
    """(index, digit) of a whole number to the base 2^32, all with its sign."""
    sign, rest, index = (-1 if number < 0 else 1), abs(number), 0
    while rest:
        yield index, sign * (rest & ((1 << _LIMB) - 1))
        rest >>= _LIMB
        index += 1


def _sums(dims, scale, pivots, centroids):
    def sums(batches):
        count, total = [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cluster, _ = _assigned(batch, dims, scale, pivots, centroids)
            for c in np.unique(cluster).tolist():
                mine = rows[cluster == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0))]
        out = [(c, -1, 0, n) for c, n in enumerate(count) if n]
        out += [(c, j, i, digit) for c, n in enumerate(count) if n for j, x in enumerate(total[c]) for i, digit in limbs(x)]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.record_batch({
            name: pa.array(values, kind) for name, values, kind in zip(
                ("cluster", "place", "limb", "digit"), columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))})
    return sums


def _labels(dims, scale, pivots, centroids):
    def labels(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, cluster, distance = _assigned(batch, dims, scale, pivots, centroids)
            long = [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(long, pa.int64())})
    return labels


def centroid_clusters(
    vectors: DataFrame, dims: int, count: int = 8, rounds: int = 10, scale: int = 1, salt: str = "3:", pivots: int = 16,
) -> Clusters:
    """Lloyd's rounds over ``vectors`` (vec_id, vector), components being floor(``scale`` * x).

    ``rows`` has vec_id, cluster and distance (squared) of every vector of exactly ``dims`` components that are neither
    NULL nor NaN nor infinite; other vectors take no part. ``centroids`` are the last ones. The first are the ``count``
    vectors with the smallest SHA-256 of ``salt`` and their vec_id (equal ids: by their components), fewer if
    there are fewer; ``pivots`` of them in that order are the pivots. A vector goes to the nearest centroid, ties to the
    smaller number; a centroid becomes the floor of its members' mean, an empty one stays.

    Rows without vec_id are assigned but start nothing, unless no row has an id: then there are no centroids and no
    rows. Repeated rows count as often as they occur. Components may be as large as doubles are; a squared distance beyond 64
    bits is NULL. Other columns are ignored; an empty table gives no rows and no centroids.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>")).where(
        F.coalesce((F.size("vector") == dims) & finite, F.lit(False)))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = usable.where("vec_id IS NOT NULL").orderBy(order, "vector").limit(max(count, pivots)).collect()
    first = [whole(np.array(r.vector, dtype=np.float64), scale).tolist() for r in first]
    centroids, fixed = first[:count], first[:pivots]
    if not centroids:
        return Clusters(usable.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance"), [])
    table = written(usable.mapInArrow(_stored(fixed, dims, scale), "vec_id bigint, vector binary, pivots binary"))
    for _ in range(rounds):
        sums = table.mapInArrow(_sums(dims, scale, fixed, centroids), "cluster int, place int, limb int, digit bigint")
        size, total = {}, {}
        for c, j, i, digit in sums.groupBy("cluster", "place", "limb").agg(F.sum("digit")).collect():
            if j < 0:
                size[c] = digit
            else:
                total[c, j] = total.get((c, j), 0) + (digit << (_LIMB * i))
        moved = [[total.get((c, j), 0) // size[c] for j in range(dims)] if c in size else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break  # later rounds would change nothing
        centroids = moved
    rows = table.mapInArrow(_labels(dims, scale, fixed, centroids), "vec_id bigint, cluster int, distance bigint")
    return Clusters(rows, centroids)
