"""Watched folders of delimited text: a stream of what appears, and scans that also notice files that have changed or gone."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.sources.store import exists, file_system

FILES = "file string, path string, size bigint, changed timestamp, part string"


def watched(spark: SparkSession, folder: str, schema: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A stream of the records of files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("sep", delimiter).option("header", header).csv(folder)


def latest(spark: SparkSession, at: str) -> int:
    """The number of the last scan that was finished, 0 before the first."""
    fs, where = file_system(spark, at)
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    done = [int(n[5:]) for n in names if re.fullmatch(r"scan-\d+", n) and exists(spark, f"{at}/{n}/_SUCCESS")]
    return max(done, default=0)


def files_of(spark: SparkSession, at: str, scan: int) -> DataFrame:
    """Files of a scan: size, time of change, and the part (a folder below ``at``) that holds its rows."""
    return spark.read.schema(FILES).parquet(f"{at}/scan-{scan}") if scan else spark.createDataFrame([], FILES)


def rows_of(spark: SparkSession, at: str, files: DataFrame, schema: str) -> DataFrame:
    """Rows of these files from the parts that hold them."""
    parts = [r["part"] for r in files.select("part").distinct().collect()]  # one for each scan that read something
    kept = files.select("file", "part")
    empty = spark.createDataFrame([], schema)
    if not parts:
        return empty
    rows = None
    for part in parts:
        own = spark.read.schema(f"{schema}, __file string").parquet(f"{at}/{part}").withColumn("__part", F.lit(part))
        rows = own if rows is None else rows.unionByName(own)
    known = rows.join(kept, (F.col("__file") == F.col("file")) & (F.col("__part") == F.col("part")), "left_semi")
    return known.select(*empty.columns)


def scanned(spark: SparkSession, folder: str, at: str, schema: str, delimiter: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The table that the files of ``folder`` and below hold now, and what has changed since the last scan: rows with ``op`` ``+`` or ``-``.

    Only files that are new, or have another size or time of change than at the last scan, are read; rows that a changed or
    lost file gave before are taken back, all of them, even where the new file has the same. ``at`` keeps rows and a list of
    files for each scan. The list is written last, so a scan that was cut short counts for nothing and is done again.
    """
    last = latest(spark, at)
    before = files_of(spark, at, last)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    m = lambda c: F.col(f"_metadata.{c}")
    now = listing.select(m("file_path").alias("file"), "path", m("file_size").alias("size"), m("file_modification_time").alias("changed"))
    same = before.select("file", "size", "changed", "part")
    part = f"part-{uuid.uuid4().hex}"
    now = now.join(same, ["file", "size", "changed"], "left").select("file", "path", "size", "changed", F.coalesce("part", F.lit(part)).alias("part")).cache()
    fresh = [r["path"] for r in now.filter(F.col("part") == part).select("path").collect()]  # names of changed files
    if fresh:
        rows = spark.read.schema(schema).option("sep", delimiter).option("header", header).csv(fresh)
        rows.withColumn("__file", m("file_path")).write.mode("overwrite").parquet(f"{at}/{part}")
    now.coalesce(1).write.mode("overwrite").parquet(f"{at}/scan-{last + 1}")
    now.unpersist()
    now = files_of(spark, at, last + 1)
    gone = before.join(now, ["file", "part"], "left_anti").select(*before.columns)
    came = now.filter(F.col("part") == part)
    table = rows_of(spark, at, now, schema)
    changes = rows_of(spark, at, gone, schema).withColumn("op", F.lit("-")).unionByName(rows_of(spark, at, came, schema).withColumn("op", F.lit("+")))
    return table, changes
