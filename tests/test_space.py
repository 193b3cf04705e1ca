"""Neighbour searches against all pairs, whatever the spread of the points."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from annograph.operators import space

SCHEMA = "sample_id string, id int, x double, y double"


def spreads():
    rng = random.Random(2)
    even = [(float(rng.randint(0, 40)), float(rng.randint(0, 40))) for _ in range(150)]
    return {
        "even": even, "outlier": [*even, (1e7, -1e7)], "one spot": [(7.0, 7.0)] * 60 + even[:30], "line": [(5.0, float(i % 50)) for i in range(120)], "single": [(1.0, 2.0)], "pair": [(1.0, 2.0), (3.0, 2.0)],
        "two densities": [(rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(80)] + [(rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6)) for _ in range(60)],
        "not a number": [*even[:40], (float("nan"), 1.0), (float("inf"), 2.0)],
    }


def frame(spark, spots):
    return spark.createDataFrame([(s, i, x, y) for s, found in spots.items() for i, (x, y) in enumerate(found)], SCHEMA)


def distances(found):
    at = [(i, p) for i, p in enumerate(found) if all(map(math.isfinite, p))]
    gap = lambda a, b: math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    return {i: sorted((gap(a, b), j) for j, b in at if j != i) for i, a in at}


@pytest.mark.parametrize("tile", [20_000, 40, 5])
def test_nearest_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(space, "LEAF", 7)
    spots = spreads()
    rows = space.nearest_tiled(frame(spark, spots), 8, tile).collect()
    got = {}
    for r in rows:
        got.setdefault((r.sample_id, r.i), []).append((r["rank"], r.d, r.j))
    for s, found in spots.items():
        for i, near in distances(found).items():
            assert [x[1:] for x in sorted(got.get((s, i), []))] == near[:8], (s, i)
    assert len(rows) == sum(min(8, len(n)) for found in spots.values() for n in distances(found).values())


@pytest.mark.parametrize("tile", [20_000, 30])
def test_pairs_within_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(space, "LEAF", 7)
    monkeypatch.setattr(space, "PAIRS", 50)
    spots = spreads()
    radius = {"even": 3.0, "outlier": 10.0, "one spot": 0.0, "line": 1.0, "pair": 2.0, "two densities": float("inf"), "not a number": 5.0}
    reach = spark.createDataFrame(list(radius.items()), "sample_id string, radius double")
    got = sorted(tuple(r) for r in space.pairs_within(frame(spark, spots), reach, tile).collect())
    assert got == sorted((s, i, j, d) for s, r in radius.items() for i, near in distances(spots[s]).items() for d, j in near if d <= r)


def test_tiles_have_like_counts(spark):
    rng = np.random.default_rng(3)
    spots = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(size=(3000, 2)), rng.normal(size=(3000, 2)) * 1e-6 + 50, [[1e9, 1e9]]]))]
    tiles, several = space.tiled(spark.createDataFrame(spots, SCHEMA.replace("string", "bigint")), 200)
    counts = [r["count"] for r in tiles.groupBy("tile").count().collect()]
    assert several and sum(counts) == 6001 and max(counts) < 500 and len(counts) > 20


def test_outlier_costs_little():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 256, (2, 6000))

    def seconds(x, y):
        start = time.perf_counter()
        found = space.Leaves(x, y, np.arange(len(x))).nearest(x, y, 9)
        return time.perf_counter() - start, found

    plain, (d, j) = seconds(x, y)
    far, (e, i) = seconds(np.append(x, 1e9), np.append(y, 1e9))
    assert (j == i[:-1]).all() and (d == e[:-1]).all()
    assert far < 2 * plain + 0.5
    check = rng.integers(0, 6000, 50)
    for q in check:
        gaps = np.sqrt((x - x[q]) ** 2 + (y - y[q]) ** 2)
        assert j[q].tolist() == np.lexsort((np.arange(6000), gaps))[:9].tolist()


def test_empty(spark):
    none = frame(spark, {"a": [(1.0, 2.0)]}).where("false")
    assert space.nearest_tiled(none, 3).count() == 0
    assert space.pairs_within(none, none.selectExpr("sample_id", "1d as radius")).count() == 0


def test_small_samples_are_searched_together(spark):
    """Samples of one leaf, of several and of several tiles in one call, with equal spots, against all pairs."""
    import math
    import random

    from annograph.operators.space import nearest_tiled, pairs_within

    rng = random.Random(2)
    rows = [(s, i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for s, n in enumerate([1, 2, 3, 3, 7, 32, 33, 90]) for i in range(n)] + [(None, i, float(i), 0.0) for i in range(4)]
    named = spark.createDataFrame([r for r in rows if r[0] is not None], "sample_id long, id int, x double, y double")
    wanted = {}
    for s, i, x, y in rows:
        if s is not None:
            wanted[s, i] = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for t, j, u, v in rows if t == s and j != i)
    for tile in (20_000, 40):
        found = {}
        for r in nearest_tiled(named, 4, tile).collect():
            found.setdefault((r.sample_id, r.i), []).append((r.rank, r.d, r.j))
        assert {k: [x[1:] for x in sorted(v)] for k, v in found.items()} == {k: v[:4] for k, v in wanted.items() if v}
        radius = named.select("sample_id").distinct().withColumn("radius", F.lit(3.0))
        pairs = sorted((r.sample_id, r.i, r.j, r.d) for r in pairs_within(named, radius, tile).collect())
        assert pairs == sorted((*k, j, d) for k, v in wanted.items() for d, j in v if d <= 3.0)
