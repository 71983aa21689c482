"""As-of and interval joins whose work is split by ranges and cells, not by key: a key with a third of all rows is many tasks' work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalis.sources.store import written


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, order: list[str] | None = None, strict: bool = False, within: float | None = None, partitions: int | None = None) -> DataFrame:
    """Each ``left`` row with the last ``right`` row of its key whose ``since`` is not after its ``at`` (before it, with ``strict``); right columns get a ``d_`` prefix.

    Right rows of one time follow each other by ``order``. ``within``: no match further back than so many seconds (or
    units of a number). Rows with a null key or time match nothing; every left row stays. Both tables are sorted
    together by ranges of key and time, so that a hot key covers many ranges. A range finds its own rows' matches;
    what it can not know is the last right row of the ranges before, one row for each key and range.
    """
    spark = left.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order or []
    place = [F.struct(*(F.col(f"d_{c}") for c in [since, *order])).alias("place")]
    hit = F.struct(*(F.col(f"d_{c}") for c in right.columns))
    renamed = right.select(*(F.col(c).alias(f"d_{c}") for c in right.columns)).dropna(subset=[f"d_{c}" for c in [*keys, since]])
    rows_r = renamed.select(*(F.col(f"d_{k}").alias(f"__k{i}") for i, k in enumerate(keys)), F.col(f"d_{since}").alias("__t"), F.lit(1 if strict else 0).alias("__side"), *place, hit.alias("hit"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l"))
    rows_l = left.dropna(subset=[*keys, at]).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(at).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(rows_r.schema["place"].dataType).alias("place"), F.lit(None).cast(rows_r.schema["hit"].dataType).alias("hit"), F.struct(*left.columns).alias("l"))
    own = [f"__k{i}" for i in range(len(keys))]
    both = written(rows_r.unionByName(rows_l).repartitionByRange(partitions, *own, "__t", "__side").withColumn("__part", F.spark_partition_id()))
    last = F.when(F.col("hit").isNotNull(), F.struct("place", "hit"))
    here = Window.partitionBy("__part", *own)
    inside = both.withColumn("__here", F.last(last, True).over(here.orderBy("__t", "__side", "place").rowsBetween(Window.unboundedPreceding, 0)))
    ends = both.filter("hit is not null").groupBy("__part", *own).agg(F.max_by("hit", F.struct("__t", "place")).alias("end"))
    parts = both.select("__part", *own).distinct().join(ends, ["__part", *own], "left")
    carried = parts.withColumn("__before", F.last("end", True).over(Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).filter("__before is not null").select("__part", *own, "__before")
    found = inside.filter("l is not null").join(carried, ["__part", *own], "left").select("l.*", F.coalesce("__here.hit", "__before").alias("__hit"))
    alone = left.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in [*keys, at]))).withColumn("__hit", F.lit(None).cast(rows_r.schema["hit"].dataType))
    out = found.unionByName(alone)
    if within is not None:
        timed = left.schema[at].dataType.simpleString().startswith("timestamp")
        number = lambda c: (c.cast("timestamp") if timed else c).cast("double")
        out = out.withColumn("__hit", F.when(number(F.col(at)) - number(F.col("__hit")[f"d_{since}"]) <= within, F.col("__hit")))
    return out.select(*left.columns, "__hit.*")


def level(a: str, b: str):
    """The power of two that is not less than the interval's length, so that it touches two cells of that size at most."""
    return F.ceil(F.log2(F.greatest(F.col(b) - F.col(a), F.lit(1.0)))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Pairs of rows of one key whose intervals share a point, ends included; right columns get a ``d_`` prefix.

    Ends are numbers or times (as seconds). Rows with a null key or end, or that end before they begin, pair with
    nothing. Each interval lies in cells of the size of its length and, to meet longer ones, in those of all larger
    sizes that occur, two at most of each. A pair meets at the longer one's size and counts in the cell where the
    later of both begins, hence once. Cells split a hot key by time.
    """

    def seconds(df: DataFrame, c: str):
        return (F.col(c).cast("timestamp") if df.schema[c].dataType.simpleString().startswith("timestamp") else F.col(c)).cast("double")

    def ready(df: DataFrame, ends: tuple[str, str], prefix: str) -> DataFrame:
        out = df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns), seconds(df, ends[0]).alias(f"{prefix}__a"), seconds(df, ends[1]).alias(f"{prefix}__b"))
        out = out.dropna(subset=[*(f"{prefix}{k}" for k in keys), f"{prefix}__a", f"{prefix}__b"]).filter(F.col(f"{prefix}__b") >= F.col(f"{prefix}__a"))
        return out.withColumn(f"{prefix}__level", level(f"{prefix}__a", f"{prefix}__b"))

    a, b = ready(left, span, ""), ready(right, other, "d_")
    sizes = sorted({r[0] for df, c in ((a, "__level"), (b, "d___level")) for r in df.select(c).distinct().collect()})  # some sixty at most
    if not sizes:
        sizes = [0]

    def spread(df: DataFrame, prefix: str) -> DataFrame:
        on = F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col(f"{prefix}__level"))
        out = df.withColumn("__size", F.explode(on))
        cell = lambda c: F.floor(F.col(f"{prefix}{c}") / F.pow(F.lit(2.0), F.col("__size"))).cast("long")
        return out.withColumn("__cell", F.explode(F.sequence(cell("__a"), cell("__b"))))

    x, y = spread(a, ""), spread(b, "d_")
    y = y.withColumnsRenamed({"__size": "d___size", "__cell": "d___cell"})
    same = [F.col(c) == F.col(f"d_{c}") for c in ["__size", "__cell", *keys]]
    out = x.join(y, reduce(lambda p, q: p & q, same))
    out = out.filter((F.col("__size") == F.greatest("__level", "d___level")) & (F.col("__a") <= F.col("d___b")) & (F.col("d___a") <= F.col("__b")))
    begins = F.floor(F.greatest("__a", "d___a") / F.pow(F.lit(2.0), F.col("__size"))).cast("long")
    return out.filter(F.col("__cell") == begins).select(*left.columns, *(f"d_{c}" for c in right.columns))
