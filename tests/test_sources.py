import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lokalis.sources import delimited, layers
from lokalis.streaming import watch


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_quotes_and_embedded_newline(spark, tmp_path):
    df = delimited.read(spark, write(tmp_path / "a.csv", 'id,t\n1,"two\nlines"\n2,"a ""q"" b"\n'))
    assert [tuple(r)[1:] for r in df.orderBy("id").collect()] == [(1, "two\nlines"), (2, 'a "q" b')]


def test_headers_types_and_blank_records(spark, tmp_path):
    df = delimited.read(spark, write(tmp_path / "b.csv", "a,A,,n,e\n1,5000000000,x,1.5,\n\n2,7,y,2,\n3\n"))
    assert df.columns == ["fid", "a", "A_1", "field_3", "n", "e"]
    assert dict(df.dtypes)["a"] == "int" and dict(df.dtypes)["A_1"] == "bigint" and dict(df.dtypes)["n"] == "double" and dict(df.dtypes)["e"] == "string"
    assert df.count() == 3 and df.filter("a = 3").first()["n"] is None


def test_delimiter_sets_patterns_and_sidecar(spark, tmp_path):
    df = delimited.read(spark, write(tmp_path / "c.txt", "a;b|c\n1;2|3\n"), delimiters=";|")
    assert tuple(df.first())[1:] == (1, 2, 3)
    df = delimited.read(spark, write(tmp_path / "d.txt", "x=1 y=2\nbad\nx=3 y=4\n"), pattern=r"^x=(\d+) y=(\d+)$", header=False)
    assert df.count() == 2 and df.columns == ["fid", "field_1", "field_2"]
    assert delimited.sidecar_types('"Integer","Real(10.2)","longlong","Foo"', 4) == ["int", "double", "bigint", "string"]
    df = delimited.read(spark, write(tmp_path / "e.csv", "v\n\"1,5\"\n\"2,25\"\n"), decimal_point=",")
    assert sorted(r["v"] for r in df.collect()) == [1.5, 2.25]


def test_geometry(spark):
    df = spark.createDataFrame([("1", "2"), ("", ""), ("x", "3")], "lon string, lat string")
    assert delimited.with_xy(df, "lon", "lat").count() == 2
    d = spark.createDataFrame([("N 10 30 00",), ("10 30 00 S",), ("N 10 30 00 S",), ("-1.5",)], "c string")
    assert [r[0] for r in d.select(delimited.degrees(F.col("c"))).collect()] == [10.5, -10.5, None, -1.5]
    w = spark.createDataFrame([("SRID=4326;POINT(1 2)",), ("LINESTRING(0 0, 4 0)",), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))",)], "g string")
    got = [(r["x"], r["y"]) for r in delimited.with_wkt(w, "g").collect()]
    assert got == [(1, 2), (2, 0), (1, 1)]
    assert delimited.xy_fields(spark.createDataFrame([(1.0, 2.0)], "px double, py double")) == ("px", "py")


def test_long_records_and_quoted_delimiters(spark, tmp_path):
    df = delimited.read(spark, write(tmp_path / "l.csv", "a,b\n1,2,3,4\n5\n"))
    assert df.columns == ["fid", "a", "b", "field_3", "field_4"] and sorted(tuple(r)[1:] for r in df.collect() if r["b"]) == [(1, 2, 3, 4)]
    df = delimited.read(spark, write(tmp_path / "q.txt", 'a;b|c\n"x;y";2|3\n"say ""hi""";|\n'), delimiters=";|")
    assert [tuple(r)[1:] for r in df.collect()] == [("x;y", 2, 3), ('say "hi"', None, None)]
    df = delimited.read(spark, write(tmp_path / "w.txt", "a  b\tc\n 1 2   3 \n"), delimiters="whitespace")
    assert tuple(df.first())[1:] == (1, 2, 3)


def test_several_files_skipped_lines_and_sidecar(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for k in range(3):
        write(tmp_path / "many" / f"{k}.csv", f"note\na;b\n{k};x\n")
    df = delimited.read(spark, str(tmp_path / "many"), delimiters=";", skip_lines=1)
    assert sorted(tuple(r)[1:] for r in df.collect()) == [(0, "x"), (1, "x"), (2, "x")]
    write(tmp_path / "s.csvt", '"String","Real(10.2)"\n')
    df = delimited.read(spark, write(tmp_path / "s.csv", "a,b\n01,2\n"))
    assert dict(df.dtypes) == {"fid": "bigint", "a": "string", "b": "double"} and df.first()["a"] == "01"


def test_centroids_take_all_parts(spark):
    shapes = ["MULTIPOINT((0 0),(2 4))", "MULTILINESTRING((0 0, 2 0),(0 2, 2 2))", "MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2, 0 0)),((4 0, 6 0, 6 2, 4 2, 4 0)))", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0),(2 0, 4 0, 4 4, 2 4, 2 0))", "4326 POINT(1 2)", None]
    got = [(r["x"], r["y"]) for r in delimited.with_wkt(spark.createDataFrame([(s,) for s in shapes], "g string"), "g").collect()]
    assert got == [(1, 2), (1, 1), (3, 1), (1, 2), (1, 2), (None, None)]
    d = spark.createDataFrame([("10\u00b030'36\"W",), ("W 10 30",), ("10 75",), ("1 2 3 4",), ("x10",), (None,), ("",), ("1000 0 0",)], "c string")
    assert [r[0] for r in d.select(delimited.degrees(F.col("c"))).collect()] == [-10.51, -10.5, None, None, None, None, None, None]


def test_geojson_of_a_line_each_is_many_tasks_work(spark, tmp_path):
    """Splits of one document give the rows, in their order, that the whole document gives."""
    feature = lambda k: '{"type":"Feature","geometry":{"type":"Point","coordinates":[%d,2]},"properties":{"n":%d,"s":"a,\\n]} %d"}}' % (k, k, k)
    some = [feature(k) for k in range(300)]
    some[7] = "null"
    by_line = ['{"type":"FeatureCollection","features":[\n' + ",\n".join(some) + "\n]}\n", '{"features": [\r\n' + " ,\r\n".join(some) + ',\r\nnull, {"properties":{"n":5}}], "crs": {"features": []}}', '{"features":[\n]}']
    others = ['{"features":[' + ",\n".join(some) + "]}", '{"features":[\n' + ",\n".join(some[:3]) + "\n],\n \"b\": 1}", '{"a":{"features":[\n' + ",\n".join(some[:3]) + '\n]}}', '{"features":[\n' + "\n,".join(some) + "\n]}"]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for k, text in enumerate(by_line + others):
            (tmp_path / f"{k}.geojson").write_bytes(text.encode())
            found = layers.features_by_lines(spark, str(tmp_path / f"{k}.geojson"))
            whole = spark.read.option("multiLine", True).schema(f"features array<{layers.FEATURE}>").json(str(tmp_path / f"{k}.geojson")).selectExpr("posexplode(features) as (fid, f)")
            assert (found is None) == (k >= len(by_line))
            if found is not None:
                key = lambda r: r[0]
                assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
        spread = layers.features_by_lines(spark, str(tmp_path / "0.geojson"))
        assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2]},"properties":{"n":3}}]}')
    r = layers.read_geojson(spark, str(tmp_path / "g.geojson")).first()
    assert (r["x"], r["y"], r["n"]) == (1.5, 2.0, 3)
    layers.export(spark.createDataFrame([(1, 1.0, 2.0)], "fid long, x double, y double"), str(tmp_path / "o"), "geojson")
    assert '"coordinates":[1.0,2.0]' in spark.read.text(str(tmp_path / "o")).first()[0]


def test_matrix_package_and_shapefile(spark, tmp_path):
    m = np.arange(6.0).reshape(2, 3)
    (tmp_path / "d.dmat").write_bytes(layers.matrix_bytes(m))
    got = layers.read_matrix(spark, str(tmp_path / "d.dmat")).toPandas()
    assert got.sort_values(["focus_id", "data_id"]).dist.tolist() == m.ravel().tolist()
    con = sqlite3.connect(tmp_path / "l.gpkg")
    con.executescript("create table gpkg_contents(table_name, data_type); create table gpkg_geometry_columns(table_name, column_name); create table t(fid integer, geom blob, v real); insert into gpkg_contents values('t','features'); insert into gpkg_geometry_columns values('t','geom')")
    con.execute("insert into t values(1, ?, 2.5)", (b"GP\0\1" + struct.pack("<i", 4326) + b"\1" + struct.pack("<Idd", 1, 3.0, 4.0),))
    con.commit()
    con.close()
    r = layers.read_geopackage(spark, str(tmp_path / "l.gpkg")).first()
    assert (r["x"], r["y"], r["v"]) == (3.0, 4.0, 2.5)
    (tmp_path / "p.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, 10) + struct.pack("<idd", 1, 5.0, 6.0))
    field = b"N".ljust(11, b"\0") + b"N" + bytes(4) + bytes([4]) + bytes(15)
    (tmp_path / "p.dbf").write_bytes(bytes(4) + struct.pack("<IHH", 1, 65, 5) + bytes(20) + field + b"\r" + b" " + b"  42")
    r = layers.read_shapefile(spark, str(tmp_path / "p.shp")).first()
    assert (r["x"], r["y"], r["N"]) == (5.0, 6.0, 42.0)


def test_centroids_of_geometry_bytes():
    from lokalis.sources import shapes

    ring = lambda *p: struct.pack("<I", len(p)) + b"".join(struct.pack("<dd", *q) for q in p)
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    hole = ring((2, 0), (4, 0), (4, 4), (2, 4), (2, 0))
    polygon = b"\1" + struct.pack("<II", 3, 2) + square + hole
    assert shapes.centroid(*shapes.from_wkb(polygon)[:2]) == (1, 2)
    other = b"\1" + struct.pack("<II", 3, 1) + ring((10, 0), (12, 0), (12, 4), (10, 4), (10, 0))
    assert shapes.centroid(*shapes.from_wkb(b"\1" + struct.pack("<II", 6, 2) + polygon + other)[:2]) == (6, 2)
    line = b"\1" + struct.pack("<II", 2, 3) + b"".join(struct.pack("<dd", *q) for q in ((0, 0), (4, 0), (4, 2)))
    assert np.allclose(shapes.centroid(*shapes.from_package(b"GP\0\1" + bytes(4) + line)), ((4 * 2 + 2 * 4) / 6, 2 / 6))
    shape = struct.pack("<i4d", 5, 0, 0, 4, 4) + struct.pack("<iiii", 2, 10, 0, 5) + b"".join(struct.pack("<dd", *q) for q in [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0), (2, 0), (4, 0), (4, 4), (2, 4), (2, 0)])
    assert shapes.centroid(*shapes.from_shape(shape)) == (1, 2)
    assert shapes.centroid(0, []) == (None, None) and shapes.from_package(None) == (0, [])


def test_project_and_watch(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "fid long, v double")
    layers.save_project(spark, str(tmp_path / "p"), {"a": df}, {"k": 1})
    got, par = layers.load_project(spark, str(tmp_path / "p"))
    assert got["a"].count() == 1 and par == {"k": 1}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("a\n1\n")
    q = watch.watched(spark, str(tmp_path / "in"), "a int").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1


@pytest.mark.parametrize("line, cells", [('a,b', ["a", "b"]), (' "a, ""x""" ,\'it\'\'s "b"\'', ['a, "x"', 'it\'s "b"']), ('"a"b,c', None), ('a"b",c', None), ('"a,b', None), ("'a\",b", None), (',""', [None, None]), ('"a";b', ["a", "b"]), ("a ,b ", ["a ", "b "])])
def test_strict_records(spark, tmp_path, line, cells):
    path = tmp_path / "t.csv"
    path.write_text(f"p,q\n1,2\n{line}\n")
    got = delimited.read(spark, str(path), ",;", "\"'", types="text", strict=True).drop("fid").collect()
    assert [list(r) for r in got] == [["1", "2"], *([cells] if cells and any(cells) else [])]
    assert delimited.invalid_records(spark, str(path), ",;", "\"'") == (cells is None)
