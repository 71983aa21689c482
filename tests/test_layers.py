"""Pruned layers, line and polygon exports, saved edits, late rows of streams, ridge rows and searches of back-fitting."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.operators import local, models
from lokalis.sources import layers, shapes
from lokalis.sources.store import folder
from lokalis.streaming import windows


def test_a_rectangle_opens_few_files(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"fid": range(4000), "x": r.uniform(0, 100, 4000), "y": r.uniform(-50, 50, 4000)})
    where = folder(spark)
    layers.write_places(spark.createDataFrame(pdf).union(spark.createDataFrame([(-1, None, 1.0)], "fid long, x double, y double")), where, 40)
    assert spark.read.parquet(where).count() == 4001
    got = layers.read_places(spark, where, 10, 0, 20, 10)
    want = pdf[pdf.x.between(10, 20) & pdf.y.between(0, 10)]
    assert sorted(x.fid for x in got.collect()) == sorted(want.fid)
    assert 1 <= len(got.inputFiles()) <= 10  # of some forty
    assert layers.read_places(spark, where, 200, 0, 210, 10).count() == 0


SHAPES = ["POINT(1 2)", "MULTIPOINT((1 2),(3 4))", "LINESTRING(0 0, 4 0, 4 4)", "MULTILINESTRING((0 0, 2 0),(0 2, 2 2))", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0),(1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2, 0 0)),((4 0, 6 0, 6 2, 4 2, 4 0),(5 0.5, 5 1, 5.5 1, 5.5 0.5, 5 0.5)))", None, "POINT EMPTY", "nonsense"]


@pytest.mark.parametrize("wkt", SHAPES)
def test_geometries_come_back_from_their_bytes(wkt):
    kind, bodies = shapes.bodies_of(wkt)
    parts = [(1.0 if k == 0 else -1.0, a) for b in bodies for k, a in enumerate(b)]
    centre = shapes.centroid(kind, parts)
    blob = shapes.to_package(kind, bodies)
    for back in (shapes.centroid(*shapes.from_package(blob)), shapes.centroid(*shapes.from_shape(shapes.to_shape(kind, bodies, kind)))):
        assert back == centre or np.allclose(back, centre)
    assert (kind == 0) == (centre == (None, None)) == (blob is None)


def test_saved_edits_leave_one_table_and_no_leftovers(spark):
    where = f"{folder(spark)}/layer"
    df = spark.createDataFrame([(k, float(k), 0.0) for k in range(5)], "fid long, x double, y double")
    assert layers.save_edits(df, where).count() == 5
    assert layers.save_edits(spark.read.parquet(where).filter("fid < 2"), where).count() == 2
    from lokalis.sources.store import exists

    assert not exists(spark, f"{where}.saving") and not exists(spark, f"{where}.before")


def test_late_rows_are_dropped_and_counted(spark):
    rows = [("2024-01-01 10:00", 1, 1), ("2024-01-05 10:00", 1, 1), ("2024-01-02 10:00", 2, 2), ("2024-01-04 20:00", 2, 2), (None, 4, 2), ("2024-01-09 10:00", 8, 2), ("2024-01-04 11:00", 16, 3), ("2024-01-08 11:00", 32, 3)]
    df = spark.createDataFrame(rows, "t string, v int, part int").select(F.to_timestamp("t").alias("t"), F.col("v").cast("long").alias("v"), "part")
    build = lambda s: windows.windowed(s, "t", "1 day", [], {"total": F.sum("v")}, late="2 days")
    updates, late = windows.in_batches(spark, df, "part", build, folder(spark))
    got = {x.window_start.day: x.total for x in updates.groupBy("window_start").agg(F.max_by("total", "__batch").alias("total")).collect()}
    assert got == {1: 1, 5: 1, 4: 2, 9: 8, 8: 32} and late == 2  # of the second part the 2nd, of the third the 4th
    assert windows.in_batches(spark, df.limit(0), "part", build, folder(spark))[0].count() == 0


def test_ridge_rows_and_searches_by_aic(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"fid": range(60), "x": r.uniform(0, 10, 60), "y": r.uniform(0, 10, 60), "a": r.normal(size=60)})
    pdf["z"] = 1 + pdf.a * pdf.x / 5 + r.normal(size=60) * 0.1
    df = spark.createDataFrame(pdf)
    plain, ridge = models.gwr(df, "z", ["a"], local.Spec(4.0))[0].toPandas(), models.ridge_gwr(df, "z", ["a"], local.Spec(4.0)).toPandas()
    for c in ("Intercept", "a", "yhat", "residual", "Intercept_SE", "a_SE", "a_TV"):
        assert np.allclose(plain[c], ridge[c])
    start = {"Intercept": local.Spec(20, "bisquare", True), "a": local.Spec(20, "bisquare", True)}
    _, diag = models.multiscale_gwr(df, "z", start, select=True, select_by="AIC", most=3)
    assert all(10 <= b <= 60 for b in diag["bandwidths"].values())
    _, held = models.multiscale_gwr(df, "z", start, select=True, most=2, limits={"a": (30.0, 31.0)})
    assert 30 <= held["bandwidths"]["a"] <= 31 and math.isfinite(held["rss"])
