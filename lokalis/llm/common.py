"""Helpers that the training-data operators share: tables, the shared work folder, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one slice of an Arrow batch holds at most (one text may be longer).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where none is set, a local default serves a local master; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "lokalis-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lokalis-{uuid.uuid4().hex}"


def file_count(rows: DataFrame, mb: int = 32) -> int:
    """In how many files to write tables made of these rows: one for each ``mb`` MB that their sources take, 8 at least. Each file costs its writer some processes (permissions are set by a shell). What heavy tasks make without a shuffle behind them takes 8."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known
        return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, size // (mb << 20))


#: How work tables are written: no success markers, and no checksum files beside local files.
PLAIN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def saved(df: DataFrame, files: int | None = None, spread: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    ``files``: at most so many, where there would be more small ones; with ``spread`` the rows, few beside what they are made of, are shuffled for that, so that the tasks that make them stay as many.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    rows = df if not files else df.repartition(files) if spread else df.coalesce(files)
    rows.write.options(**PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote for these tables, once everything made of them is written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of finished shuffles' files before new ones are written: Spark's cleaner deletes them, beside the driver, once the driver's collector finds them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def bounded_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch small enough for a worker that holds very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``most`` bytes in each piece; rows are never cut or lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_forget: dict[str, Callable[[], None]] = {}


def worker_memory(owner: str, forget: Callable[[], None]) -> None:
    """Called where an operator starts in a worker: what other operators remember in this process is dropped and given back, and large blocks go back to the system as soon as they are free."""
    if not _forget:
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 2)):  # glibc's mapping and trimming thresholds, number of arenas
            libc.mallopt(option, value)
        pa.set_memory_pool(pa.system_memory_pool())
    others = [k for k in _forget if k != owner]
    for k in others:
        _forget.pop(k)()
    _forget[owner] = forget
    if others:
        ctypes.CDLL(None).malloc_trim(0)
