"""Other layer sources and all sinks: GeoJSON, GeoPackage, shapefiles, distance matrices, exports, projects."""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lokalis.sources import ranged, shapes
from lokalis.sources.delimited import detected
from lokalis.sources.store import written


def geojson_parts(geometry: dict | None) -> tuple[int, shapes.Parts]:
    kind, at = (geometry or {}).get("type", ""), (geometry or {}).get("coordinates")
    xy = lambda a: np.array([p[:2] for p in a], float).reshape(-1, 2)
    if kind == "GeometryCollection":
        own = [geojson_parts(g) for g in geometry["geometries"]]
        top = max((k for k, _ in own), default=0)
        return top, [p for k, parts in own if k == top for p in parts]
    if not at:
        return 0, []
    if kind in ("Point", "MultiPoint"):
        return 1, [(1.0, xy([at] if kind == "Point" else at))]
    if kind in ("LineString", "MultiLineString"):
        return 2, [(1.0, xy(a)) for a in ([at] if kind == "LineString" else at)]
    return 3, [(1.0 if k == 0 else -1.0, xy(r)) for rings in ([at] if kind == "Polygon" else at) for k, r in enumerate(rings)]


FEATURE = "struct<properties:string,geometry:string>"
#: Characters of a document's first and last line, at most, where features have lines of their own.
MOST_END = 1 << 20


def ends_of_collection(head: str, tail: str) -> int:
    """How many features stand in the last line of a document whose first line ends with the opening of its features; -1 if it is not so."""
    try:
        top, end = json.loads(head + "]}", object_pairs_hook=list), json.loads('{"features":[' + tail, object_pairs_hook=list)
    except ValueError:
        return -1
    if not isinstance(top, list) or not isinstance(end, list) or [v for k, v in top if k == "features"] != [[]] or top[-1][0] != "features":
        return -1
    return len(end[0][1]) if [k for k, _ in end].count("features") == 1 and all(map(is_feature, json.loads('{"features":[' + tail)["features"])) else -1


def is_feature(value) -> bool:
    return value is None or isinstance(value, dict)


def is_feature_text(text: str) -> bool:
    try:
        return is_feature(json.loads(text))
    except ValueError:
        return False


def features_by_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """``fid, f`` of documents with a line for each feature, so that a document is many tasks' work; None if one of them is not so made.

    The first line opens the list of features, the last one ends it, and each line between is one JSON object or null with a comma
    behind it (the last of them only if features follow in the last line). What a line holds is then what the document holds there.
    """
    lines = written(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"))
    end = F.struct("block", "row", F.substring("value", 1, MOST_END).alias("value"))
    ends = lines.groupBy("file").agg(F.count("*").alias("n"), F.min(end).alias("head"), F.max(end).alias("tail"))

    @F.pandas_udf("int")
    def counted(head: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series([ends_of_collection(a, b) for a, b in zip(head, tail)], dtype="int32")

    @F.pandas_udf("boolean")
    def parsed(body: pd.Series) -> pd.Series:
        return pd.Series([is_feature_text(v) for v in body], dtype=bool)

    ends = written(ends.select("file", "n", F.when(F.col("n") > 1, counted("head.value", "tail.value")).otherwise(-1).alias("last")))
    if ends.filter("last < 0").limit(1).count():
        return None
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))  # a row for each block of a file
    placed = lines.join(F.broadcast(blocks), ["file", "block"]).join(F.broadcast(ends), "file").withColumn("k", F.col("before") + F.col("row") - F.col("first"))
    comma = ~((F.col("k") == F.col("n") - 2) & (F.col("last") == 0))
    body = F.when(comma, F.regexp_extract("value", r"(?s)^(.*),\s*$", 1)).otherwise(F.col("value"))
    between = placed.filter("k > 0 and k < n - 1").select((F.col("k") - 1).alias("fid"), body.alias("body"))
    if between.filter(~parsed("body")).limit(1).count():
        return None
    last = placed.filter("k = n - 1").select("n", F.from_json(F.concat(F.lit('{"features":['), "value"), f"features array<{FEATURE}>").alias("d")).select("n", F.posexplode("d.features").alias("at", "f"))
    return between.select("fid", F.from_json(F.concat(F.lit('{"features":['), "body", F.lit("]}")), f"features array<{FEATURE}>")["features"][0].alias("f")).unionByName(last.select((F.col("n") - 2 + F.col("at")).alias("fid"), "f"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features' properties with ``fid`` (their place in their document), ``kind`` and the centroid ``x, y``. Documents with a line for each feature are read by lines, others are one task's each."""
    rows = features_by_lines(spark, path)
    if rows is None:
        raw = spark.read.option("multiLine", True).schema(f"features array<{FEATURE}>").json(path)
        rows = raw.select(F.posexplode("features").alias("fid", "f"))
    rows = rows.select(F.col("fid").cast("long").alias("fid"), F.col("f.properties").alias("p"), F.col("f.geometry").alias("g"))

    @F.pandas_udf("kind string, x double, y double")
    def located(g: pd.Series) -> pd.DataFrame:
        known = [json.loads(v) if v else None for v in g]
        xy = [shapes.centroid(*geojson_parts(v)) for v in known]
        return pd.DataFrame({"kind": [v.get("type") if v else None for v in known], "x": pd.array([p[0] for p in xy], "Float64"), "y": pd.array([p[1] for p in xy], "Float64")})

    rows = rows.select("fid", "p", located("g").alias("at")).select("fid", "p", "at.*")
    keys = [r[0] for r in rows.select(F.explode(F.json_object_keys("p"))).distinct().collect()]  # column names
    names = [k for k in sorted(keys) if k not in ("fid", "kind", "x", "y")]
    out = rows.select("fid", "kind", "x", "y", *(F.get_json_object("p", f"$['{k}']").alias(k) for k in names))
    return detected(out, names, keep=("kind", "x", "y"))


#: How SQLite's declared types become column types; others are text.
PACKAGE_TYPES = {"INT": "bigint", "BOOL": "bigint", "REAL": "double", "DOUB": "double", "FLOA": "double"}


def opened(blob: bytes) -> sqlite3.Connection:
    """A database of bytes, in memory."""
    con = sqlite3.connect(":memory:")
    con.deserialize(blob)
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A GeoPackage's feature table; geometries become their centroids x and y. Files are read in tasks, each whole; only the columns' names reach the driver."""

    def describe(batches):
        for pdf in batches:
            for blob in pdf.content:
                con = opened(blob)
                name = layer or con.execute("select table_name from gpkg_contents where data_type = 'features' order by 1").fetchone()[0]
                geometry = con.execute("select column_name from gpkg_geometry_columns where table_name = ?", (name,)).fetchone()[0]
                columns = [(r[1], PACKAGE_TYPES.get((r[2] or "").upper()[:4], PACKAGE_TYPES.get((r[2] or "").upper()[:3], "string"))) for r in con.execute(f"pragma table_info({quoted(name)})")]
                yield pd.DataFrame({"spec": [json.dumps([name, geometry, columns])]})

    raw = spark.read.format("binaryFile").load(path).select("content")
    name, geometry, columns = json.loads(raw.limit(1).mapInPandas(describe, "spec string").first()[0])
    own = [(c, t) for c, t in columns if c != geometry and c.lower() not in ("x", "y", "fid")]
    key = next((c for c, _ in columns if c.lower() == "fid"), "rowid")

    def run(batches):
        for pdf in batches:
            for blob in pdf.content:
                at = opened(blob).execute(f"select {quoted(key)}, {quoted(geometry)}{''.join(f', {quoted(c)}' for c, _ in own)} from {quoted(name)}")
                while rows := at.fetchmany(10_000):
                    fid, shape, *rest = zip(*rows)
                    x, y = zip(*(shapes.centroid(*shapes.from_package(g)) for g in shape))
                    values = [list(map(str_or_none, v)) if t == "string" else list(v) for v, (_, t) in zip(rest, own)]
                    out = {"x": pd.array(x, "Float64"), "y": pd.array(y, "Float64"), "fid": fid} | {c: pd.array(v, {"bigint": "Int64", "double": "Float64"}.get(t, "object")) for v, (c, t) in zip(values, own)}
                    yield pd.DataFrame(out)

    return raw.mapInPandas(run, "x double, y double, fid bigint" + "".join(f", `{c}` {t}" for c, t in own))


def str_or_none(v) -> str | None:
    return None if v is None else str(v)


def read_shapefile(spark: SparkSession, path: str, columns: list[str] | None = None, records: int = ranged.RECORDS) -> DataFrame:
    """Shapes' centroids with the attributes (``columns``, else all) of the ``.dbf`` beside the ``.shp``. With the index ``.shx`` beside them each ``records`` records are a task's; without it, or where files have no path, the pair is read in one task and only the attributes' names reach the driver."""
    local = ranged.opened_by_path(spark, path)
    if local and os.path.isfile(local) and os.path.isfile(local[:-4] + ".shx"):
        return ranged.load(spark, ranged.ShapeSource, local, records=records, columns=",".join(columns or []))
    raw = spark.read.format("binaryFile").load([path, path[:-4] + ".dbf"]).select("path", "content")
    pair = raw.groupBy(F.regexp_replace("path", r"\.\w+$", "").alias("base")).agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf"))

    def describe(batches):
        for pdf in batches:
            for dbf in pdf.dbf:
                yield pd.DataFrame({"spec": [json.dumps(ranged.attribute_head(dbf)[3])]})

    fields = json.loads(pair.limit(1).mapInPandas(describe, "spec string").first()[0])
    numeric = {name for name, kind, _ in fields if kind in "NF"}

    def run(batches):
        for pdf in batches:
            for shp, dbf in zip(pdf.shp, pdf.dbf):
                n, start, width, own = ranged.attribute_head(dbf)
                xy, at = [], 100
                while at < len(shp):
                    size = struct.unpack_from(">i", shp, at + 4)[0] * 2
                    xy.append(shapes.centroid(*shapes.from_shape(shp[at + 8 : at + 8 + size])))
                    at += 8 + size
                out = {"fid": range(n), "x": pd.array([p[0] for p in xy], "Float64"), "y": pd.array([p[1] for p in xy], "Float64")}
                for name, values in ranged.attribute_cells(dbf[start:], n, width, own):
                    out[name] = pd.array(values, "Float64") if name in numeric else values
                yield pd.DataFrame(out)

    rows = pair.mapInPandas(run, "fid bigint, x double, y double" + "".join(f", `{name}` {ranged.attribute_type(kind)}" for name, kind, _ in fields))
    return rows.select("fid", "x", "y", *(f"`{c}`" for c in columns)) if columns else rows


def read_matrix(spark: SparkSession, path: str, store: str = "rows", cells: int = ranged.CELLS) -> DataFrame:
    """``focus_id, data_id, dist`` of a binary matrix: int32 rows, int32 columns, float64 by rows (``store``: or by columns). Each ``cells`` cells are a task's; files without a path are read in one task each."""
    local = ranged.opened_by_path(spark, path)
    if local and os.path.isfile(local):
        return ranged.load(spark, ranged.MatrixSource, local, cells=cells, store=store)

    def run(batches):
        for pdf in batches:
            for blob in pdf.content:
                rows, cols = struct.unpack_from("<ii", blob)
                d = np.frombuffer(blob, "<f8", rows * cols, 8)
                d = d.reshape(cols, rows).T.ravel() if store == "columns" else d
                for lo in range(0, rows, 1000):
                    i = np.arange(lo, min(rows, lo + 1000))
                    yield pd.DataFrame({"focus_id": np.repeat(i, cols), "data_id": np.tile(np.arange(cols), len(i)), "dist": d[lo * cols : (lo + len(i)) * cols]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "focus_id bigint, data_id bigint, dist double")


def write_matrix(matrix: DataFrame, path: str, transpose: bool = False) -> None:
    """A long distance table as Parquet, the form that joins use; ``transpose`` swaps the ids."""
    a, b = ("data_id", "focus_id") if transpose else ("focus_id", "data_id")
    matrix.select(F.col(a).alias("focus_id"), F.col(b).alias("data_id"), "dist").write.mode("overwrite").parquet(path)


def matrix_bytes(rows: np.ndarray) -> bytes:
    """A small dense matrix in the binary form."""
    out = io.BytesIO()
    out.write(struct.pack("<ii", *rows.shape))
    out.write(np.ascontiguousarray(rows, "<f8").tobytes())
    return out.getvalue()


#: Rows of a layer that is written as one file.
MOST_FILE_ROWS = 1_000_000


def gathered(df: DataFrame) -> pd.DataFrame:
    """A layer for a format of one file: brought to the driver behind a count."""
    if (n := df.count()) > MOST_FILE_ROWS:
        raise ValueError(f"{n} rows: formats of one file take {MOST_FILE_ROWS} at most")
    return df.toPandas()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Bytes through Spark's file systems; what is there is replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(data)
    out.close()


def package_bytes(df: DataFrame, layer: str) -> bytes:
    """A GeoPackage with one layer: points ``x, y``, or the geometries of a ``wkt`` column, and attributes."""
    pdf = gathered(df)
    names = [c for c in df.columns if c not in ("fid", "x", "y", "wkt")]
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}
    con = sqlite3.connect(":memory:")
    con.execute("pragma application_id = 1196444487")  # "GPKG"
    con.executescript("create table gpkg_contents(table_name text primary key, data_type text, identifier text, srs_id integer); create table gpkg_geometry_columns(table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
    con.execute(f"create table {quoted(layer)}(fid integer primary key, geom blob{''.join(f', {quoted(c)} {kinds.get(t, "TEXT")}' for c, t in df.dtypes if c in names)})")
    con.execute("insert into gpkg_contents values(?, 'features', ?, 4326)", (layer, layer))
    con.execute("insert into gpkg_geometry_columns values(?, 'geom', ?, 4326, 0, 0)", (layer, "GEOMETRY" if "wkt" in df.columns else "POINT"))
    point = lambda x, y: None if pd.isna(x) or pd.isna(y) else b"GP\0\1" + struct.pack("<iBIdd", 4326, 1, 1, x, y)
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    blobs = [shapes.to_package(*shapes.bodies_of(w)) for w in pdf.wkt] if "wkt" in df.columns else [point(x, y) for x, y in zip(pdf.x, pdf.y)]
    rows = zip(pdf.fid, blobs, *(pdf[c] for c in names))
    con.executemany(f"insert into {quoted(layer)} values({', '.join('?' * (2 + len(names)))})", ([int(fid), blob, *map(plain, rest)] for fid, blob, *rest in rows))
    con.commit()
    return con.serialize()


def shape_bytes(df: DataFrame) -> tuple[bytes, bytes]:
    """The ``.shp`` and ``.dbf`` of a layer: points ``x, y``, or the geometries of a ``wkt`` column, all of the kind of the first one (others are written without geometry); numbers with 18 digits, other attributes as text."""
    pdf = gathered(df).sort_values("fid")
    names = [c for c in df.columns if c not in ("fid", "x", "y", "wkt")]
    numeric = {c for c, t in df.dtypes if t in ("bigint", "int", "double", "float")}
    if "wkt" in df.columns:
        known = [shapes.bodies_of(w) for w in pdf.wkt]
        of = next((k for k, _ in known if k), 1)
        bodies, code = [shapes.to_shape(*g, of) for g in known], {1: 8, 2: 3, 3: 5}[of]
        every = [a for k, g in known if k == of for b in g for a in b]
        x, y = (pd.Series(np.concatenate(every)[:, c] if every else []) for c in (0, 1))
    else:
        bodies, code = [struct.pack("<i", 0) if pd.isna(x) or pd.isna(y) else struct.pack("<idd", 1, x, y) for x, y in zip(pdf.x, pdf.y)], 1
        x, y = pdf.x.dropna(), pdf.y.dropna()
    records = b"".join(struct.pack(">ii", k, len(b) // 2) + b for k, b in enumerate(bodies, 1))
    box = [x.min(), y.min(), x.max(), y.max()] if len(x) and len(y) else [0.0] * 4
    shp = struct.pack(">i20xi", 9994, (100 + len(records)) // 2) + struct.pack("<ii4d32x", 1000, code, *box) + records
    cells = {c: [("" if pd.isna(v) else repr(float(v)) if c in numeric else str(v)).encode()[:254] for v in pdf[c]] for c in names}
    width = {c: max([1, *map(len, cells[c])]) for c in names}
    fields = b"".join(c.encode()[:10].ljust(11, b"\0") + (b"N" if c in numeric else b"C") + bytes(4) + bytes([width[c]]) + bytes(15) for c in names)
    rows = b"".join(b" " + b"".join(cells[c][k].rjust(width[c]) if c in numeric else cells[c][k].ljust(width[c]) for c in names) for k in range(len(pdf)))
    return shp, b"\3" + bytes(3) + struct.pack("<IHH", len(pdf), 33 + 32 * len(names), 1 + sum(width.values())) + bytes(20) + fields + b"\r" + rows + b"\x1a"


def index_of(shp: bytes) -> bytes:
    """The ``.shx`` of a ``.shp``: offset and length of each record."""
    out, at = [], 100
    while at < len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0]
        out.append(struct.pack(">ii", at // 2, size))
        at += 8 + 2 * size
    return shp[:24] + struct.pack(">i", 50 + 4 * len(out)) + shp[28:100] + b"".join(out)


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV with x and y, GeoJSON feature lines, or one file as ``gpkg`` or ``shp`` (points, or a ``wkt`` column's geometries); an existing target is replaced."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "geojson":
        rest = [c for c in df.columns if c not in ("x", "y")]
        feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
        df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
    elif kind == "gpkg":
        write_file(df.sparkSession, path, package_bytes(df, "layer"))
    elif kind == "shp":
        shp, dbf = shape_bytes(df)
        write_file(df.sparkSession, path, shp)
        write_file(df.sparkSession, path[:-4] + ".dbf", dbf)
        write_file(df.sparkSession, path[:-4] + ".shx", index_of(shp))
    else:
        df.write.mode("overwrite").parquet(path)


def z_order(box: tuple[float, float, float, float]) -> Column:
    """Rows' places along a curve that keeps what is near together: 16 bits of x and y by turns."""
    x0, y0, x1, y1 = box
    part = lambda c, lo, hi: F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((F.col(c) - lo) / max(hi - lo, 1e-300) * 65535))).cast("long")
    u, v = part("x", x0, x1), part("y", y0, y1)
    bit = lambda c, k, to: F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), to)
    out = F.lit(0).cast("long")
    for k in range(16):
        out = out + bit(u, k, 2 * k) + bit(v, k, 2 * k + 1)
    return out


def write_places(df: DataFrame, path: str, files: int = 64) -> None:
    """A layer as Parquet files of neighbouring points, and beside it (``path.boxes``) the box of each file. Points without a place go to files of their own box, null."""
    spark = df.sparkSession
    box = df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    z = z_order(tuple(float(v) if v is not None else 0.0 for v in box))
    df.withColumn("__z", z).repartitionByRange(files, F.col("__z").asc_nulls_last()).sortWithinPartitions("__z").drop("__z").write.mode("overwrite").parquet(path)
    boxes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")))
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}.boxes")


def read_places(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows of ``write_places`` in a rectangle, borders included; only files whose box meets it are opened."""
    boxes = spark.read.parquet(f"{path}.boxes")
    met = boxes.filter((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))
    names = [r["file"] for r in met.select("file").collect()]  # at most as many as the layer has files
    rows = spark.read.parquet(*names) if names else spark.read.parquet(path).limit(0)
    return rows.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def save_edits(df: DataFrame, path: str) -> DataFrame:
    """An edited layer written over the table that it may have been read from. The new table is written beside it, the old one is put aside, and only when the new one is in its place is the old one deleted: at any moment one of both is whole, under ``path``, ``.saving`` or ``.before``."""
    context = df.sparkSession.sparkContext
    target, fresh, aside = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.saving", f"{path}.before"))
    df.write.mode("overwrite").parquet(fresh.toString())
    store = target.getFileSystem(context._jsc.hadoopConfiguration())
    if store.exists(target):
        store.delete(aside, True)
        if not store.rename(target, aside):
            raise OSError(f"the saved layer stays at {fresh.toString()}")
    if not store.rename(fresh, target):
        store.rename(aside, target)
        raise OSError(f"the saved layer stays at {fresh.toString()}")
    store.delete(aside, True)
    return df.sparkSession.read.parquet(path)


def report(title: str, diagnostics: dict, overall: dict | None = None, names: list[str] | None = None, calibration: dict | None = None, quartiles: DataFrame | None = None) -> str:
    """A plain text report of a model: the global regression (``models.ols_of`` with its coefficients' ``names``), how the model was calibrated, its diagnostics, and the coefficients' quartile table (``summary.quartile_table``). Parts that are not given are left out."""
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)

    def listed(values: dict) -> list[str]:
        width = max([len(k) for k in values] + [1])
        return [f"{k.ljust(width)}  {shown(v)}" for k, v in values.items()]

    def table(head: list[str], rows: list[list]) -> list[str]:
        cells = [head, *([shown(v) for v in r] for r in rows)]
        width = [max(len(r[k]) for r in cells) for k in range(len(head))]
        return ["  ".join([r[0].ljust(width[0]), *(v.rjust(w) for v, w in zip(r[1:], width[1:]))]) for r in cells]

    lines = [title, "=" * len(title)]
    if overall:
        rows = [[n, *map(float, v)] for n, *v in zip(names or [], overall["beta"], overall["se"], overall["t"])]
        lines += ["", "Global regression", "-----------------", *table(["", "Estimate", "SE", "t"], rows), *listed({k: float(overall[k]) for k in ("rss", "r2", "adj_r2", "aic", "aicc") if k in overall})]
    if calibration:
        lines += ["", "Calibration", "-----------", *listed(calibration)]
    if overall or calibration or quartiles is not None:
        lines += ["", "Diagnostics", "-----------"]
    lines += listed(diagnostics)
    if quartiles is not None:
        rows = [list(r) for r in quartiles.select("name", "q0", "q1", "q2", "q3", "q4").collect()]  # a row for each coefficient
        lines += ["", "Coefficients", "------------", *table(["", "Min", "1st Qu.", "Median", "3rd Qu.", "Max"], rows)]
    return "\n".join(lines) + "\n"


def save_report(spark: SparkSession, path: str, text: str) -> None:
    """A report as one UTF-8 file; what is there is replaced."""
    write_file(spark, path, text.encode())


def save_project(spark: SparkSession, path: str, layers: dict[str, DataFrame], parameters: dict) -> None:
    """Each layer as Parquet and a JSON manifest beside them."""
    for name, df in layers.items():
        export(df, f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"layers": sorted(layers), "parameters": parameters}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_project(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    spec = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    return {n: spark.read.parquet(f"{path}/{n}") for n in spec["layers"]}, spec["parameters"]
