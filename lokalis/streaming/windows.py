"""Windowed aggregates of streams of timed rows: late rows up to a watermark still count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, length: str, keys: list[str], aggregates: dict, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``window_start``, the keys and named aggregates of each window; state older than the watermark ``late`` is dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    rows = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return rows.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def drained(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """What a stream holds now, as a table: every update is written below ``folder``, the last one of a window counts."""
    out, state = f"{folder}/updates-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).withColumn("__batch", F.lit(0).cast("long")).write.parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

    query = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def in_batches(spark: SparkSession, rows: DataFrame, batch: str, build: Callable[[DataFrame], DataFrame], folder: str) -> tuple[DataFrame, int]:
    """``rows`` fed to a stream by the ascending values of ``batch``, as they would arrive: each value's rows are one file drop and one start of the query on the same checkpoint.

    ``build`` makes the streaming aggregate, whose updates are kept with their number (``__batch``). Also returns how many rows came
    too late for the watermark and were dropped, by the state operators' own count (a row that several windows drop counts for each).
    """
    arrivals, out, state = f"{folder}/arrivals", f"{folder}/updates", f"{folder}/state"
    first, late = 0, 0
    for (value,) in sorted(rows.select(batch).filter(F.col(batch).isNotNull()).distinct().collect()):
        rows.filter(F.col(batch) == F.lit(value)).coalesce(1).write.mode("append").parquet(arrivals)
        stream = build(spark.readStream.schema(rows.schema).parquet(arrivals))

        def keep(part: DataFrame, number: int) -> None:
            part.withColumn("__batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        late += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
        first += 1
    if not first:
        return spark.createDataFrame([], build(rows.filter("false")).schema).withColumn("__batch", F.lit(0).cast("long")), 0
    return spark.read.parquet(out), late
