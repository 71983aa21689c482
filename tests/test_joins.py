"""As-of and interval joins, nearest neighbours and projections against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.functions import projection
from lokalis.operators import joins, neighbours


def timed(n, seed, key_none=True):
    r = random.Random(seed)
    keys = ["hot"] * 8 + ["a", "b", *([None] if key_none else [])]
    return [(k, r.choice(keys), r.choice([None, *range(40)]), r.randint(0, 3)) for k in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 4])
def test_as_of_equals_brute_force(spark, partitions, strict, within):
    left, right = timed(150, 1), timed(120, 2)
    l, r = (spark.createDataFrame(x, "id long, k string, t long, o long").repartition(3) for x in (left, right))  # noqa: E741
    got = {x.id: x.d_id for x in joins.as_of(l, r, ["k"], "t", "t", ["o", "id"], strict, within, partitions).collect()}
    want = {}
    for i, k, t, _ in left:
        before = [(u, o, j) for j, q, u, o in right if None not in (k, q, t, u) and q == k and (u < t if strict else u <= t)]
        best = max(before, default=None)
        want[i] = best[2] if best and (within is None or t - best[0] <= within) else None
    assert got == want


def test_as_of_of_nothing_and_of_times(spark):
    l = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long")  # noqa: E741
    assert [x.d_id for x in joins.as_of(l, l.limit(0), ["k"], "t", "t").collect()] == [None]
    assert joins.as_of(l.limit(0), l, ["k"], "t", "t").count() == 0
    times = l.withColumn("t", F.timestamp_seconds("t"))
    assert joins.as_of(times, times.withColumn("t", F.col("t") - F.expr("interval 10 seconds")), ["k"], "t", "t", within=9).first().d_id is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_brute_force_once_each(spark, seed):
    r = random.Random(seed)

    def rows(n):
        out = []
        for k in range(n):
            a = r.choice([None, *range(-50, 50)])
            out.append((k, r.choice(["hot"] * 5 + ["a", None]), a, None if a is None else a + r.choice([-1, 0, 0, 1, 2, 5, 40, 90])))
        return out

    left, right = rows(70), rows(80)
    l, q = (spark.createDataFrame(x, "id long, k string, a long, b long") for x in (left, right))  # noqa: E741
    got = sorted((x.id, x.d_id) for x in joins.overlapping(l, q, ["k"], ("a", "b"), ("a", "b")).collect())
    fine = lambda x: None not in x and x[3] >= x[2]
    assert got == sorted((x[0], y[0]) for x in left for y in right if fine(x) and fine(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert joins.overlapping(l.limit(0), q, ["k"], ("a", "b"), ("a", "b")).count() == 0


@pytest.mark.parametrize("leaf", [3, 2000])
@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_equal_brute_force(spark, monkeypatch, leaf, k):
    r = np.random.default_rng(leaf + k)
    monkeypatch.setattr(neighbours, "VISITORS", 5)
    xy = np.concatenate([np.zeros((40, 2)), r.integers(0, 6, (40, 2)), r.normal(size=(30, 2)) * 0.01 + 50, [[-0.0, 0.0], [1e6, 0]]])
    data = pd.DataFrame({"fid": r.permutation(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    focus = pd.concat([data, pd.DataFrame({"fid": [900, 901], "x": [-1e5, 50.0], "y": [3.0, 49.0]})])
    f = spark.createDataFrame(focus).union(spark.createDataFrame([(950, None, 1.0)], "fid long, x double, y double"))
    d = spark.createDataFrame(data).union(spark.createDataFrame([(951, 1.0, None)], "fid long, x double, y double"))
    got = {(x.fid, x["rank"]): (x.d_fid, x.d) for x in neighbours.nearest(f, d, k, leaf).collect()}
    want = {}
    for i, x, y in focus.itertuples(index=False):
        for rank, (dist, j) in enumerate(sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in data.itertuples(index=False))[:k], 1):
            want[i, rank] = (j, dist)
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and math.isclose(got[q][1], want[q][1], abs_tol=1e-12) for q in want)
    assert neighbours.nearest(f, d.limit(0), k, leaf).count() == 0 and neighbours.nearest(f, d, 1000, leaf).filter("fid = 900").count() == len(data)


def test_leaves_are_even_for_clustered_places():
    r = np.random.default_rng(1)
    xy = np.concatenate([r.normal(size=(5000, 2)) * 1e-3, r.normal(size=(5000, 2)) * 100])
    tree = neighbours.tree_of(xy[::2], 50)
    sizes = np.bincount(tree.leaf_of(xy))
    sizes = sizes[sizes > 0]
    assert len(sizes) >= 32 and sizes.max() <= 4 * sizes.mean()


def test_zones_there_and_back(spark):
    r = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(r.uniform(-180, 180, 300), r.uniform(-80, 84, 300)))]
    rows += [(900, 3.0, 0.0), (901, None, 1.0), (902, 10.0, 89.0), (903, 180.0, 5.0), (904, float("nan"), 5.0)]
    df = spark.createDataFrame(rows, "fid long, x double, y double")
    there = projection.to_zones(df)
    back = {x.fid: (x.x, x.y) for x in projection.from_zones(there).collect()}
    assert set(back) == {f for f, *_ in rows} - {901, 902, 904}
    for f, x, y in rows:
        if f in back:
            assert abs((back[f][0] - x + 180) % 360 - 180) < 1e-9 and abs(back[f][1] - y) < 1e-9
    origin = there.filter("fid = 900").first()
    assert (origin.zone, round(origin.x, 6), round(origin.y, 6)) == (31, 500000.0, 0.0)


def test_zones_equal_the_arc_of_the_meridian(spark):
    """On a central meridian the northing is the meridian's arc, here by numerical integration."""
    lats = [-60.0, 1.0, 30.0, 75.0]
    got = {x.y0: x.y for x in projection.to_zones(spark.createDataFrame([(k, 9.0, y, y) for k, y in enumerate(lats)], "fid long, x double, y double, y0 double")).collect()}
    f = projection.FLATTENING
    e2 = f * (2 - f)
    for lat in lats:
        t = np.linspace(0, math.radians(lat), 200_001)
        v = projection.EQUATOR * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5
        arc = float(((v[1:] + v[:-1]) / 2 * np.diff(t)).sum()) * projection.SCALE
        assert abs(got[lat] - (arc + (projection.NORTHING if lat < 0 else 0))) < 1e-3
