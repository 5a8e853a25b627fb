"""Centroid clusters against a plain version."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from uptake.llm import centroids

CLASHES = ("cluster", "distance", "pivots", "place", "digit", "a b.c")


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumns({c: F.lit("x") for c in CLASHES})


def plain(rows, dims, count, rounds, scale, salt="3:"):
    rows = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:count]]
    if not centres:
        return [], []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    return sorted((i, *nearest(v)[::-1]) for i, v in rows), centres


def found(spark, rows, **options):
    out = centroids.centroid_clusters(frame(spark, rows), **options)
    return sorted(tuple(r) for r in out.rows.collect()), out.centroids


def test_against_a_plain_version(spark):
    draw = np.random.default_rng(3)
    blobs = draw.normal(size=(6, 8)) * 3
    rows = [(i, (blobs[i % 6] + draw.normal(size=8)).tolist()) for i in range(600)]
    for count, rounds, pivots in ((8, 10, 16), (8, 10, 8), (20, 3, 1), (1, 2, 3)):
        options = {"dims": 8, "count": count, "rounds": rounds, "scale": 1024}
        mine, centres = found(spark, rows, pivots=pivots, **options)
        assert (mine, centres) == plain(rows, **options)


def test_ties_repeated_rows_and_empty_centroids(spark):
    # Many equal vectors: equal start centroids, of which all but the first stay empty.
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(5, [2.0, 1.0])] * 4
    options = {"dims": 2, "count": 8, "rounds": 4, "scale": 1}
    assert found(spark, rows, **options) == plain(rows, **options)
    halves = [(i, [0.5 * (-1) ** i, -0.25]) for i in range(9)]
    options["scale"] = 4
    assert found(spark, halves, **options) == plain(halves, **options)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [4.0, -2.5]), (3, None), (4, []), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [-inf, 1.0]), (10, [None, 1.0]), (11, [3.0, 3.0])]
    options = {"dims": 2, "count": 2, "rounds": 3, "scale": 1024}
    mine, centres = found(spark, rows, **options)
    assert (mine, centres) == plain(rows, **options) and [r[0] for r in mine] == [1, 2, 11]
    # Rows without an id are assigned but start nothing.
    with_null, _ = centroids.centroid_clusters(frame(spark, [*rows, (None, [9.0, 9.0])]), **options)
    assert sorted((r.vec_id is None for r in with_null.collect())) == [False] * 3 + [True]
    assert found(spark, [(None, [1.0, 1.0])], **options) == ([], [])
    assert found(spark, [], **options) == ([], [])
    fewer, centres = found(spark, rows[:1], dims=2, count=8, scale=1024)
    assert fewer == [(1, 0, 0)] and centres == [[1024, 2048]]


@pytest.mark.parametrize("size", [1e3, 2.0 ** 20, 1e9, 1e30, 1e308])
def test_large_components_are_exact(spark, size):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=3).clip(-1.7, 1.7) * size).tolist()) for i in range(40)] + [(99, [0.1, 0.2, 0.3])]
    options = {"dims": 3, "count": 4, "rounds": 3, "scale": 1024}
    mine, centres = found(spark, rows, **options)
    expected, expected_centres = plain(rows, **options)
    assert centres == expected_centres
    assert mine == [(i, c, d if d < 2 ** 63 else None) for i, c, d in expected]


def test_pivots_spare_distances():
    """Bounds never exceed distances, and clustered vectors need few of them."""
    draw = np.random.default_rng(7)
    blobs = draw.integers(-4000, 4000, size=(8, 16))
    rows = blobs[draw.integers(0, 8, 2000)] + draw.integers(-40, 40, size=(2000, 16))
    pivots = rows[:8].tolist()
    table = np.stack([centroids.roots(centroids.squared(rows, p)) for p in pivots], axis=1)
    centres = blobs.tolist()
    against = np.stack([centroids.roots(centroids.squared(blobs, p)) for p in pivots], axis=1)
    bound = centroids.lower_bounds(table, against)
    exact = np.stack([centroids.roots(centroids.squared(rows, c)) for c in centres], axis=1)
    assert (bound <= exact).all()
    cluster, distance, computed = centroids.nearest(rows, bound, centres)
    assert (cluster == exact.argmin(axis=1)).all() and (np.sqrt(distance) == exact.min(axis=1)).all()
    assert computed < 2.5 * len(rows)


def test_limbs_add_up():
    for number in (0, 1, -1, 2 ** 32, -(2 ** 32) - 5, 10 ** 40, -(10 ** 300)):
        assert sum(digit << (32 * i) for i, digit in centroids.limbs(number)) == number
        assert all(abs(digit) < 2 ** 32 for _, digit in centroids.limbs(number))
