"""Files of a fixed layout by ranges: shapefiles and distance matrices as Python data sources whose partitions are runs of records, and matrices written by many tasks.

Ranges need files that tasks open by path (local or a shared mount). ``opened_by_path`` tells; files elsewhere are read whole by ``layers``.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lokalis.operators.local import Spec, distances
from lokalis.sources import shapes
from lokalis.sources.store import file_system

#: Records of a shapefile and cells of a matrix that one task reads; cells that one task writes; rows of a batch.
RECORDS, CELLS, WRITTEN, BATCH = 50_000, 1 << 22, 1 << 20, 8192


def opened_by_path(spark: SparkSession, path: str) -> str | None:
    """The path by which tasks can open this file; None on file systems that have none."""
    fs, at = file_system(spark, path)
    url = urlparse(fs.makeQualified(at).toString())
    return unquote(url.path) if url.scheme == "file" else None


@dataclass
class Run(InputPartition):
    """Records ``first`` to before ``end``."""

    first: int
    end: int


def runs(n: int, size: int) -> list[Run]:
    return [Run(lo, min(n, lo + size)) for lo in range(0, n, size)] or [Run(0, 0)]


def attribute_head(dbf: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """Records, where they start, their width, and name, kind and width of each field."""
    n, start, width = struct.unpack_from("<IHH", dbf, 4)
    return n, start, width, [(dbf[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(dbf[k + 11]), dbf[k + 16]) for k in range(32, start - 1, 32)]


def attribute_type(kind: str) -> str:
    return "double" if kind in "NF" else "string"


def attribute_cells(rows: bytes, n: int, width: int, fields: list[tuple[str, str, int]]) -> Iterator[tuple[str, list]]:
    """Each field's values in ``n`` records; blank cells and those of stars only are null."""
    place = 1
    for name, kind, size in fields:
        cells = [rows[k * width + place : k * width + place + size].decode("utf-8", "replace").strip() for k in range(n)]
        yield name, [float(v) if v.strip("*") else None for v in cells] if kind in "NF" else [v or None for v in cells]
        place += size


class ShapeSource(DataSource):
    """Shapes' centroids ``x, y`` and attributes, with ``fid`` (the record's place). Options: ``path``, ``records`` of a task, ``columns`` (attributes, comma-joined; default all)."""

    @classmethod
    def name(cls) -> str:
        return "lokalis_shapes"

    def fields(self) -> list[tuple[str, str, int]]:
        with open(self.options["path"][:-4] + ".dbf", "rb") as f:
            start = struct.unpack_from("<H", f.read(32), 8)[0]
            f.seek(0)
            return attribute_head(f.read(start))[3]

    def schema(self) -> str:
        wanted = self.options["columns"].split(",") if self.options.get("columns") else None
        own = [(n, k) for n, k, _ in self.fields() if wanted is None or n in wanted]
        return "fid bigint, x double, y double" + "".join(f", `{n}` {attribute_type(k)}" for n, k in own)

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options["path"], int(self.options.get("records", RECORDS)), schema.names)


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, records: int, names: list[str]):
        self.path, self.records, self.names = path, records, names

    def partitions(self) -> list[Run]:
        """Runs of the index's records, which have eight bytes each."""
        return runs((os.path.getsize(self.path[:-4] + ".shx") - 100) // 8, self.records)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        base = self.path[:-4]
        with open(base + ".shx", "rb") as index, open(self.path, "rb") as shp, open(base + ".dbf", "rb") as dbf:
            start = struct.unpack_from("<H", dbf.read(32), 8)[0]
            dbf.seek(0)
            n, start, width, fields = attribute_head(dbf.read(start))
            kinds = {name: kind for name, kind, _ in fields}
            for lo in range(partition.first, min(partition.end, n), BATCH):
                hi = min(partition.end, n, lo + BATCH)
                index.seek(100 + 8 * lo)
                xy = []
                for offset, size in struct.iter_unpack(">ii", index.read(8 * (hi - lo))):
                    shp.seek(2 * offset + 8)
                    xy.append(shapes.centroid(*shapes.from_shape(shp.read(2 * size))))
                dbf.seek(start + lo * width)
                cells = dict(attribute_cells(dbf.read((hi - lo) * width), hi - lo, width, fields)) if len(self.names) > 3 else {}
                columns = [pa.array(range(lo, hi), pa.int64()), *(pa.array([p[k] for p in xy], pa.float64()) for k in (0, 1))]
                columns += [pa.array(cells[c], pa.float64() if attribute_type(kinds[c]) == "double" else pa.string()) for c in self.names[3:]]
                yield pa.RecordBatch.from_arrays(columns, self.names)


class MatrixSource(DataSource):
    """``focus_id, data_id, dist`` of a binary matrix. Options: ``path``, ``cells`` of a task, ``store`` (``rows`` or ``columns``: what lies together)."""

    @classmethod
    def name(cls) -> str:
        return "lokalis_matrix"

    def schema(self) -> str:
        return "focus_id bigint, data_id bigint, dist double"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("cells", CELLS)), self.options.get("store", "rows"))


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, cells: int, store: str):
        self.path, self.cells, self.store = path, cells, store

    def size(self) -> tuple[int, int]:
        with open(self.path, "rb") as f:
            return struct.unpack("<ii", f.read(8))

    def partitions(self) -> list[Run]:
        rows, cols = self.size()
        return runs(rows * cols, self.cells)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        rows, cols = self.size()
        with open(self.path, "rb") as f:
            f.seek(8 + 8 * partition.first)
            for lo in range(partition.first, partition.end, BATCH):
                hi = min(partition.end, lo + BATCH)
                d, at = np.frombuffer(f.read(8 * (hi - lo)), "<f8"), np.arange(lo, hi)
                own = (at % rows, at // rows) if self.store == "columns" else (at // cols, at % cols)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*own, d)], ["focus_id", "data_id", "dist"])


def load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def started(spark: SparkSession, path: str, rows: int, cols: int) -> tuple[str, str]:
    """The target as tasks open it, and the file beside it that has a head and gets the cells."""
    target = opened_by_path(spark, path)
    if target is None:
        raise ValueError("tasks must be able to open the target by its path")
    fresh = f"{target}.saving"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(fresh, "wb") as f:
        f.write(struct.pack("<ii", rows, cols))
    return target, fresh


def put_cells(fresh: str, first: int, values: np.ndarray) -> None:
    with open(fresh, "r+b") as f:
        f.seek(8 + 8 * first)
        f.write(values.astype("<f8").tobytes())
        f.flush()
        os.fsync(f.fileno())


def finished(target: str, fresh: str, rows: int, cols: int) -> None:
    if os.path.getsize(fresh) != 8 + 8 * rows * cols:
        raise OSError(f"the matrix at {fresh} is not whole")
    os.replace(fresh, target)


def write_matrix_file(matrix: DataFrame, path: str, rows: int, cols: int, store: str = "rows", cells: int = WRITTEN) -> None:
    """A binary matrix of ``rows`` by ``cols`` from ``focus_id, data_id, dist`` (places from 0), by rows or by columns.

    The file is cut into runs of ``cells`` cells; each run is one group, put at its offset by one task into a file beside the
    target, which takes the target's place when all runs are there. A run that is written again after a lost executor has the
    same bytes. Cells that are missing or null are NaN; a repeated cell or one outside is an error, and the target stays as it was.
    """
    spark = matrix.sparkSession
    target, fresh = started(spark, path, rows, cols)
    i, j = F.col("focus_id").cast("long"), F.col("data_id").cast("long")
    place = j * rows + i if store == "columns" else i * cols + j
    inside = i.between(0, rows - 1) & j.between(0, cols - 1)
    # each run has one row of its own, so that runs without cells are written too
    ends = spark.range(0, -(-rows * cols // cells)).select((F.col("id") * cells).alias("place"), F.lit(None).cast("double").alias("dist"), F.lit(0).alias("cell"))
    given = matrix.select(F.when(inside, place).otherwise(F.raise_error(F.lit("a cell lies outside of the matrix")).cast("long")).alias("place"), F.col("dist").cast("double").alias("dist"), F.lit(1).alias("cell"))

    def put(group: pd.DataFrame) -> pd.DataFrame:
        first = int(group["place"].min()) // cells * cells
        own = group[group["cell"] == 1]
        at = own["place"].to_numpy() - first
        if len(np.unique(at)) < len(at):
            raise ValueError("a cell of the matrix is given twice")
        out = np.full(min(cells, rows * cols - first), np.nan)
        out[at] = own["dist"].to_numpy(float)
        put_cells(fresh, first, out)
        return pd.DataFrame({"n": [len(own)]})

    done = given.unionByName(ends).groupBy(F.floor(F.col("place") / cells).alias("run")).applyInPandas(put, "n bigint")
    done.agg(F.sum("n")).collect()
    finished(target, fresh, rows, cols)


def write_distance_file(spark: SparkSession, path: str, spec: Spec, focus: np.ndarray, data: np.ndarray, store: str = "rows", cells: int = WRITTEN) -> None:
    """The distances of ``focus`` (rows) to ``data`` (columns), both places x and y, as a binary matrix.

    Each task makes the cells of its runs from the places, which are broadcast, and puts them at their offset: no cell is shuffled, a
    task holds one run, and the disk holds the file only. A run that is written again after a lost executor has the same bytes.
    """
    rows, cols = len(focus), len(data)
    target, fresh = started(spark, path, rows, cols)
    first, second = (data, focus) if store == "columns" else (focus, data)  # distances are the same both ways
    width, held = len(second), spark.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = held.value
        for k in (k for pdf in batches for k in pdf.id.tolist()):
            at, end, parts = k * cells, min(rows * cols, (k + 1) * cells), []
            while at < end:
                line, lo = divmod(at, width)
                hi = min(width, lo + end - at)
                parts.append(distances(spec, first[line : line + 1], second[lo:hi])[0])
                at += hi - lo
            put_cells(fresh, k * cells, np.concatenate(parts))
            yield pd.DataFrame({"n": [end - k * cells]})

    count = -(-rows * cols // cells)
    done = spark.range(0, count, 1, max(1, min(count, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0]
    held.destroy()
    if (done or 0) != rows * cols:
        raise OSError(f"{done} of {rows * cols} cells were written")
    finished(target, fresh, rows, cols)
