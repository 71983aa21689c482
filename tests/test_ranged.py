"""Shapefiles and matrices by ranges of their files."""

import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.operators import local
from lokalis.plans import catalog, format_queries
from lokalis.sources import layers, ranged


def test_a_shapefile_is_many_tasks(spark, tmp_path):
    n = 1000
    pdf = pd.DataFrame({"fid": range(n), "x": np.arange(n) * 0.5, "y": np.arange(n) % 7.0, "v": np.arange(n) / 4, "s": [f"é{k}" if k % 3 else None for k in range(n)]})
    pdf.loc[5, "x"] = None
    path = str(tmp_path / "p.shp")
    layers.export(spark.createDataFrame(pdf), path, "shp")
    got = layers.read_shapefile(spark, path, records=300)
    assert got.rdd.getNumPartitions() == 4 and got.columns == ["fid", "x", "y", "v", "s"]
    own = got.toPandas().sort_values("fid").reset_index(drop=True)
    assert np.isnan(own.x[5]) and np.isnan(own.y[5])
    assert own.drop(5)[["fid", "x", "y", "v"]].equals(pdf.drop(5)[["fid", "x", "y", "v"]]) and own.s[4] == "é4" and own.s[3] is None
    os.remove(str(tmp_path / "p.shx"))  # read whole
    whole = layers.read_shapefile(spark, path)
    assert whole.toPandas().sort_values("fid").reset_index(drop=True).equals(own)
    assert layers.read_shapefile(spark, path, ["s"]).columns == ["fid", "x", "y", "s"]


def test_a_shapefile_gives_wanted_columns_only_and_may_be_empty(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 2.0, "a", 3.0)], "fid long, x double, y double, s string, v double")
    for name, rows in (("one", df), ("none", df.filter("false"))):
        path = str(tmp_path / f"{name}.shp")
        layers.export(rows, path, "shp")
        got = layers.read_shapefile(spark, path, ["v"])
        assert got.columns == ["fid", "x", "y", "v"] and [tuple(r) for r in got.collect()] == ([(0, 1.0, 2.0, 3.0)] if name == "one" else [])


@pytest.mark.parametrize("store", ["rows", "columns"])
@pytest.mark.parametrize("cells", [7, 64, 1 << 20])
def test_matrices_are_written_and_read_by_many_tasks(spark, tmp_path, store, cells):
    r = np.random.default_rng(3)
    m = r.normal(size=(23, 11))
    long = spark.createDataFrame(pd.DataFrame({"focus_id": np.repeat(np.arange(23), 11), "data_id": np.tile(np.arange(11), 23), "dist": m.ravel()}))
    long = long.filter("NOT (focus_id BETWEEN 4 AND 9)").withColumn("dist", F.when(F.col("focus_id") != 2, F.col("dist")))
    path = str(tmp_path / "m.dmat")
    ranged.write_matrix_file(long, path, 23, 11, store, cells)
    m[[2, *range(4, 10)]] = np.nan
    blob = open(path, "rb").read()
    assert struct.unpack("<ii", blob[:8]) == (23, 11)
    assert np.array_equal(np.frombuffer(blob[8:], "<f8"), (m.T if store == "columns" else m).ravel(), equal_nan=True)
    assert not os.path.exists(path + ".saving")
    got = layers.read_matrix(spark, path, store, 50)
    assert got.rdd.getNumPartitions() == 6
    back = got.toPandas().pivot(index="focus_id", columns="data_id", values="dist").to_numpy()
    assert np.array_equal(back, m, equal_nan=True)


def test_wrong_cells_leave_the_old_matrix(spark, tmp_path):
    path = str(tmp_path / "m.dmat")
    cell = lambda *rows: spark.createDataFrame(list(rows), "focus_id long, data_id long, dist double")
    ranged.write_matrix_file(cell((0, 0, 1.0)), path, 1, 1)
    for wrong in (cell((0, 0, 1.0), (0, 0, 2.0)), cell((0, 1, 1.0)), cell((-1, 0, 1.0)), cell((None, 0, 1.0))):
        with pytest.raises(Exception, match="matrix"):
            ranged.write_matrix_file(wrong, path, 1, 1)
    assert layers.read_matrix(spark, path).collect() == [(0, 0, 1.0)]
    ranged.write_matrix_file(cell(), path, 0, 0)
    assert layers.read_matrix(spark, path).count() == 0


@pytest.mark.parametrize("store", ["rows", "columns"])
@pytest.mark.parametrize("cells", [7, 64, 1 << 20])
def test_distances_are_written_where_they_are_made(spark, tmp_path, store, cells):
    r = np.random.default_rng(4)
    a, b = r.uniform(size=(23, 2)), r.uniform(size=(11, 2))
    path = str(tmp_path / "d.dmat")
    ranged.write_distance_file(spark, path, local.Spec(0, metric="manhattan"), a, b, store, cells)
    back = layers.read_matrix(spark, path, store, 50).toPandas().pivot(index="focus_id", columns="data_id", values="dist").to_numpy()
    assert np.array_equal(back, np.abs(a[:, None] - b[None]).sum(2)) and not os.path.exists(path + ".saving")
    ranged.write_distance_file(spark, path, local.Spec(0), a[:0], b, store, cells)
    assert layers.read_matrix(spark, path).count() == 0


@pytest.mark.parametrize("store", ["rows", "columns"])
def test_the_matrix_of_suppliers_has_a_line_for_each_place(spark, tmp_path, store, monkeypatch):
    keys = [1, 2, 1 + 101 * 97, 2 + 2 * 101 * 97]  # two places
    spark.createDataFrame([(k, 1.0) for k in keys], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    at = str(tmp_path / "files")
    monkeypatch.setattr(format_queries, "folder", lambda s: at)
    got = {(r.focus_id, r.data_id): r.dist for r in catalog.QUERIES[f"matrix_file_by_{store}"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): abs(i * 37 % 101 - j * 37 % 101) + abs(i * 53 % 97 - j * 53 % 97) for i in keys for j in keys}
    assert os.path.getsize(f"{at}/suppliers.dmat") == 8 + 8 * 2 * 2
