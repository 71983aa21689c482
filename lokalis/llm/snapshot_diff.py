"""Difference of two snapshots of a keyed table whose rows may have got new keys.

Rows of equal keys are pairs. What is left is paired by content: within each content the i-th smallest earlier key
goes with the i-th smallest later one. Both pairings are a join on (group, rank), so a key or a content that holds
a third of all rows is as many join keys as it has rows. Ranks come from ``ranked``: a global sort by ranges, whose
partitions may cut a group anywhere, and sums of the partitions' counts for the groups that they cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

EARLIER, LATER = 0, 1
#: Sort keys that each partition of a sort by ranges gives to the driver for the ranges' limits, about three times over.
SAMPLED = 40


def counted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each (group, side) run of a sorted partition from 1."""
    part, at, last, run = TaskContext.get().partitionId(), 0, None, 0
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        same = ((pdf.gid == pdf.gid.shift()) & (pdf.side == pdf.side.shift())).to_numpy(copy=True)
        same[0] = last == (pdf.gid.iat[0], pdf.side.iat[0])
        place = np.arange(n)
        begun = np.maximum.accumulate(np.where(same, -1, place))  # -1: the run goes on from the last batch
        pdf["run"] = np.where(begun < 0, run + place + 1, place - begun + 1)
        pdf["part"], pdf["at"] = part, at + place
        last, run, at = (pdf.gid.iat[-1], pdf.side.iat[-1]), int(pdf.run.iat[-1]), at + n
        yield pdf


def ranked(rows: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rank`` of each row, from 1 by ``order``, among those of its ``gid`` (binary, never null) and ``side``; also the saved table it reads.

    Sort keys end with ``salt``, so even equal rows are dealt over several partitions. Each partition numbers its own
    rows. A group that a partition begins with may have rows in partitions before: these are counted by partition,
    and the sums go to the rows of the group. At most one such group a partition, so what is broadcast has at most
    ``partitions`` rows for each group begun there, whatever the number of rows.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["gid", "side", *order, "salt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", run bigint, part int, at bigint"
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(SAMPLED))
    try:
        local = saved(rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(counted_runs, schema))
    finally:
        spark.conf.set(setting, before)
    cut = local.filter("at = 0").select("gid", "side").distinct()
    counts = local.join(F.broadcast(cut), ["gid", "side"]).groupBy("gid", "side", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("gid", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("before", earlier).filter("before > 0").drop("n")
    out = local.join(F.broadcast(carried), ["gid", "side", "part"], "left")
    return out.withColumn("rank", F.col("run") + F.coalesce("before", F.lit(0))).drop("run", "part", "at", "before"), local


def matched(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Rows of both sides joined on (gid, rank): ``old`` and ``new`` structs, one of them null where there is no partner."""
    side = lambda k, name: rows.filter(F.col("side") == k).select("gid", "rank", F.struct(*payload).alias(name))
    return side(EARLIER, "old").join(side(LATER, "new"), ["gid", "rank"], "full").select("old", "new")


def digest(c: Column) -> Column:
    """32 bytes of a column's value, null for null."""
    return F.unhex(F.sha2(c.cast("string"), 256))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns, joined by line feeds, null as ``~``; 32 bytes."""
    return F.unhex(F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns)), 256))


def difference(earlier: DataFrame, later: DataFrame, key: str, content: str, columns: list[str]) -> DataFrame:
    """``key, old_key, op, changed, row_sha256`` of each pair and each row without a partner.

    ``columns`` (``content`` among them) are compared and go into the later row's digest; other columns, which may
    have any names, are not looked at. ``op``: same or update for equal keys, rekey for pairs by content, insert,
    delete. ``changed``: a pair's differing columns in the order of ``columns``, joined by commas. Nulls equal only
    nulls, for keys as well. Repeated keys pair in the order of their rows' digests, repeats beyond the other side's
    count among what is left over. Empty tables give only inserts or only deletes, two empty ones no rows.
    Only digests and keys are shuffled, so the length of texts does not matter.
    """
    values = [f"v{k}" for k in range(len(columns))]
    payload = ["key", *values, "sha"]

    def narrow(df: DataFrame, side: int) -> DataFrame:
        cols = [digest(F.col(f"`{c}`")).alias(v) for c, v in zip(columns, values)]
        return df.select(F.col(f"`{key}`").cast("long").alias("key"), *cols, row_digest(columns).alias("sha"), F.lit(side).alias("side"), F.monotonically_increasing_id().alias("salt"))

    rows = saved(narrow(earlier, EARLIER).union(narrow(later, LATER)))
    by_key, kept = ranked(rows.withColumn("gid", F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), ["sha"])
    first = saved(matched(by_key, [*payload, "salt"]))
    discard(rows, kept)
    same = {c: F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}")) for c, v in zip(columns, values)}
    changed = F.concat_ws(",", *(F.when(~s, F.lit(c)) for c, s in same.items()))
    head = [F.col("new.key").alias("key"), F.col("old.key").alias("old_key")]
    pairs = first.filter("old is not null and new is not null").select(*head, F.when(changed == "", "same").otherwise("update").alias("op"), changed.alias("changed"), F.lower(F.hex("new.sha")).alias("row_sha256"))
    alone = first.filter("old is null or new is null").select(F.coalesce("new", "old").alias("r"), F.when(F.col("new").isNull(), EARLIER).otherwise(LATER).alias("side")).select("r.*", "side")
    inner = values[columns.index(content)]
    by_content, _ = ranked(alone.withColumn("gid", F.coalesce(inner, F.lit(b""))), ["key"])
    second = matched(by_content, payload)
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("rekey")
    rest = second.select(F.when(F.col("new").isNotNull(), F.col("new.key")).otherwise(F.col("old.key")).alias("key"), F.col("old.key").alias("old_key"), op.alias("op"), F.when(op == "rekey", changed).otherwise("").alias("changed"), F.lower(F.hex("new.sha")).alias("row_sha256"))
    return pairs.unionByName(rest)


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later state that the query compares with: the remainder of crc32 of the decimal ``doc_id`` by 16 drops, changes, rekeys or copies a row. Rows with a null id stay as they are."""
    m = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16
    m = F.coalesce(m, F.lit(15))
    other = -1 - F.col("doc_id").cast("long")
    plain = F.struct(
        F.when(m.isin(3, 4), other).otherwise(F.col("doc_id").cast("long")).alias("doc_id"),
        F.when(m == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(m == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(m == 2, F.col("lang")).when(m == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )
    copy = F.struct(other.alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    both = F.when(m == 0, F.array().cast("array<struct<doc_id:bigint,text:string,lang:string,source:string>>")).when(m == 5, F.array(plain, copy)).otherwise(F.array(plain))
    return docs.select(F.explode(both).alias("r")).select("r.*")
