"""Focus-data pairs with distances and kernel weights: the join below every local model."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokalis.functions import distance as dist
from lokalis.functions import kernels
from lokalis.operators import sites
from lokalis.sources.store import written

#: Data points up to this number are broadcast in an all-pairs join (some 40 bytes each); more are shuffled by grid cell or, for kernels without an edge, joined nested.
BROADCAST_POINTS = 500_000


@dataclass(frozen=True)
class Bandwidth:
    """``size`` as a distance, or with ``adaptive`` as a number of nearest data points, the focus itself included."""

    size: float
    kernel: str = "gaussian"
    adaptive: bool = False
    distance: dist.Distance = dist.euclidean


def small(data: DataFrame) -> DataFrame:
    """Broadcast behind a count; else left to the planner."""
    return F.broadcast(data) if data.count() <= BROADCAST_POINTS else data


def all_pairs(focus: DataFrame, data: DataFrame, distance: dist.Distance = dist.euclidean) -> DataFrame:
    """Every focus (``fid, x, y``) with every data row; data columns get a ``d_`` prefix, the distance is ``d``."""
    spark = focus.sparkSession
    # dealt by focus, whatever the files: beside a broadcast the pairs stay so, and are summed by focus where they are made
    f = focus.repartition(4 * spark.sparkContext.defaultParallelism, "fid")
    d = data.select(*(F.col(c).alias(f"d_{c}") for c in data.columns))
    out = f.crossJoin(small(d))
    return out.withColumn("d", distance(F.col("x"), F.col("y"), F.col("d_x"), F.col("d_y")))


def within(focus: DataFrame, data: DataFrame, radius: float) -> DataFrame:
    """Pairs of at most ``radius`` euclidean distance by a grid: equi-joins on cells, each focus looks into its nine neighbours. Nothing is broadcast."""
    step = float(radius) if radius > 0 else 1.0
    cell = lambda c: F.floor(F.col(c) / F.lit(step))
    near = F.array(*(F.struct((cell("x") + i).alias("gx"), (cell("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    f = focus.withColumn("g", F.explode(near)).withColumn("gx", F.col("g.gx")).withColumn("gy", F.col("g.gy")).drop("g")
    d = data.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    d = d.select("gx", "gy", *(F.col(c).alias(f"d_{c}") for c in data.columns))
    out = f.join(d, ["gx", "gy"]).drop("gx", "gy")
    return out.withColumn("d", dist.euclidean(F.col("x"), F.col("y"), F.col("d_x"), F.col("d_y"))).filter(F.col("d") <= F.lit(float(radius)))


def ringed(focus: DataFrame, data: DataFrame, step: float, r: int) -> DataFrame:
    """Pairs of foci with the data in the cells up to ``r`` beyond their own, by equi-joins; nothing is broadcast."""
    cell = lambda c: F.floor(F.col(c) / F.lit(step))
    ring = F.sequence(F.lit(-r), F.lit(r))
    f = focus.withColumn("__i", F.explode(ring)).withColumn("__j", F.explode(ring)).withColumn("gx", cell("x") + F.col("__i")).withColumn("gy", cell("y") + F.col("__j")).drop("__i", "__j")
    d = data.select(cell("x").alias("gx"), cell("y").alias("gy"), *(F.col(c).alias(f"d_{c}") for c in data.columns))
    out = f.join(d, ["gx", "gy"]).drop("gx", "gy")
    return out.withColumn("d", dist.euclidean(F.col("x"), F.col("y"), F.col("d_x"), F.col("d_y")))


def nearest(focus: DataFrame, data: DataFrame, k: int, distance: dist.Distance = dist.euclidean, ties: bool = False) -> DataFrame:
    """The ``k`` nearest data rows of each focus, ties by data id, with their ``rank`` from 1; with ``ties`` all rows as near as the k-th.

    Foci of one place share their neighbours, and of the data at one place only the ``k`` smallest ids are looked at
    (without ``ties``). Euclidean neighbours are looked for in growing rings of grid cells: a focus is done when its k-th distance lies
    inside the rings seen, and only the others look further. Other metrics meet all rows.
    """
    w = Window.partitionBy("fid").orderBy("d", "d_fid") if not ties else Window.partitionBy("fid").orderBy("d")
    place = (F.rank() if ties else F.row_number()).over(w)
    if distance is not dist.euclidean:
        return all_pairs(focus, data, distance).withColumn("rank", place).filter(F.col("rank") <= k)
    if not ties:
        once, own = sites.of(focus.dropna(subset=list(sites.PLACE))), focus
        few = Window.partitionBy(*sites.PLACE).orderBy("fid")
        data = written(data.withColumn("__at", F.row_number().over(few)).filter(F.col("__at") <= k).drop("__at"))
        found = by_rings(once, data, k, place).drop("x", "y")
        placed = once.withColumnRenamed("fid", "__site").join(found.withColumnRenamed("fid", "__site"), "__site").drop("__site")
        return own.join(placed, list(sites.PLACE)).select(*own.columns, *(c for c in found.columns if c != "fid"))
    return by_rings(focus, data, k, place)


def by_rings(focus: DataFrame, data: DataFrame, k: int, place: Column) -> DataFrame:
    box = data.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y"))).first()
    own = focus.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y"))).first()
    if not box["n"] or own["min_x"] is None:
        return all_pairs(focus.limit(0), data.limit(0)).withColumn("rank", place)
    wide, high = box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    far = math.hypot(max(box["max_x"], own["max_x"]) - min(box["min_x"], own["min_x"]), max(box["max_y"], own["max_y"]) - min(box["min_y"], own["min_y"]))
    step = max(math.sqrt(max(wide * high, 1e-12) * k / box["n"]), max(wide, high) * k / box["n"], far * 1e-6, 1e-9)
    wanted, left, found, r = min(k, box["n"]), focus, [], 1
    while True:
        ranked = written(ringed(left, data, step, r).withColumn("rank", place).filter(F.col("rank") <= k))
        if r * step >= far:  # every row has been seen
            return reduce(DataFrame.unionByName, [*found, ranked])
        done = ranked.groupBy("fid").agg(F.count("*").alias("n"), F.max("d").alias("reach")).filter((F.col("n") >= wanted) & (F.col("reach") < r * step)).select("fid")
        found.append(ranked.join(done, "fid", "left_semi"))
        left = written(left.join(done, "fid", "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        r *= 2


def reach(pairs: DataFrame, count: float, n: int, rows: str | None = None) -> DataFrame:
    """Each focus's adaptive bandwidth ``b``: its distance to the count-th nearest row, scaled from the largest beyond all ``n``. Where data are sites, ``rows`` names the column of their rows."""
    at = max(1, int(count))
    if rows and count <= n:
        ordered = F.array_sort(F.collect_list(F.struct("d", F.col(rows).cast("long").alias("n"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
        further = lambda s, e: F.when(s["n"] >= at, s).otherwise(F.struct((s["n"] + e["n"]).alias("n"), e["d"].alias("d")))
        return pairs.groupBy("fid").agg(ordered.alias("o")).select("fid", F.aggregate("o", start, further)["d"].alias("b"))
    ordered = F.array_sort(F.collect_list("d"))
    b = F.element_at(ordered, F.least(F.lit(at), F.size(ordered))) if count <= n else F.max("d") * F.lit(count / n)
    return pairs.groupBy("fid").agg(b.alias("b"))


def weighted(focus: DataFrame, data: DataFrame, bw: Bandwidth, rows: str | None = None) -> DataFrame:
    """Pairs with weight ``w``. Compact kernels of a fixed euclidean bandwidth meet by grid cells, and adaptive ones beyond BROADCAST_POINTS rows by rings of cells, so far pairs are never made. Where data are sites, ``rows`` names the column of their rows."""
    if not bw.adaptive and bw.kernel in kernels.COMPACT and bw.distance is dist.euclidean and bw.size > 0:
        return within(focus, data, bw.size).withColumn("w", kernels.weight(bw.kernel, F.col("d"), F.lit(float(bw.size))))
    n = data.agg(F.sum(rows) if rows else F.count("*")).first()[0] or 0 if bw.adaptive else 0
    if bw.adaptive and bw.kernel in kernels.COMPACT and bw.distance is dist.euclidean and bw.size <= n and data.count() > BROADCAST_POINTS:
        # rows beyond have no weight; so many sites have as many rows at least
        near = written(nearest(focus, data, max(1, int(bw.size)), ties=True).drop("rank"))
        b = reach(near.select("fid", "d", f"d_{rows}"), bw.size, n, f"d_{rows}") if rows else near.groupBy("fid").agg(F.max("d").alias("b"))
        return near.join(b, "fid").withColumn("w", kernels.weight(bw.kernel, F.col("d"), F.col("b")))
    if not bw.adaptive:
        return all_pairs(focus, data, bw.distance).withColumn("w", kernels.weight(bw.kernel, F.col("d"), F.lit(float(bw.size))))
    b = reach(all_pairs(focus, data.select("x", "y", *([rows] if rows else [])), bw.distance), bw.size, n, f"d_{rows}" if rows else None)
    return all_pairs(focus.join(b, "fid"), data, bw.distance).withColumn("w", kernels.weight(bw.kernel, F.col("d"), F.col("b")))


def weighted_sums(focus: DataFrame, data: DataFrame, bw: Bandwidth, terms: dict[str, Column], squares: dict[str, Column] | None = None) -> DataFrame:
    """``fid`` and the sum by weight of each of the ``terms`` of data rows (for ``squares``, by squared weight), by the places of both tables; foci without pairs have no row."""
    own = focus.select("fid", *sites.PLACE).dropna()
    known = sites.of(data.dropna(subset=list(sites.PLACE)), {"rows": F.count("*"), **{k: F.sum(c) for k, c in {**terms, **(squares or {})}.items()}})
    once = sites.of(own)
    w = F.col("w")
    sums = weighted(once, known, bw, "rows").groupBy("fid").agg(*(F.sum(w * F.col(f"d_{k}")).alias(k) for k in terms), *(F.sum(w * w * F.col(f"d_{k}")).alias(k) for k in squares or {}))
    return sites.back(once, sums, own, how="inner")


def distance_summary(focus: DataFrame, data: DataFrame, distance: dist.Distance = dist.euclidean, radius: float | None = None, lag: str | None = None, scale: float = 0.0) -> DataFrame:
    """``fid, n, sum_d, mean_d, max_d, min_d`` of each focus over the data rows, or those up to ``radius`` (euclidean), by the places of both tables.

    With ``lag``, a column of both, distances are joined with its difference by ``scale``.
    """
    by = (*sites.PLACE, lag) if lag else sites.PLACE
    own = focus.select("fid", *by)
    once, known = sites.of(own, by=by), sites.of(data, {"rows": F.count("*")}, by)
    met = all_pairs(once, known, distance) if radius is None else within(once, known, radius)
    met = met.withColumn("d", dist.space_time(F.col("d"), F.col(lag), F.col(f"d_{lag}"), scale)) if lag else met
    found = met.groupBy("fid").agg(F.sum("d_rows").alias("n"), F.sum(F.col("d") * F.col("d_rows")).alias("sum_d"), F.sum(F.when(F.col("d").isNotNull(), F.col("d_rows"))).alias("__of"), F.max("d").alias("max_d"), F.min("d").alias("min_d"))
    return sites.back(once, found.select("fid", "n", "sum_d", F.try_divide("sum_d", "__of").alias("mean_d"), "max_d", "min_d"), own, by, "inner")


def from_matrix(focus: DataFrame, data: DataFrame, matrix: DataFrame) -> DataFrame:
    """Pairs whose distance stands in a ``focus_id, data_id, dist`` table, which is not shuffled where the points are few enough to be broadcast."""
    m = matrix.select(F.col("focus_id").alias("fid"), F.col("data_id").alias("d_fid"), F.col("dist").alias("d"))
    d = data.select(*(F.col(c).alias(f"d_{c}") for c in data.columns))
    return m.join(small(focus), "fid").join(small(d), "d_fid")


def extremes(pairs: DataFrame) -> DataFrame:
    """Largest and smallest distance over all pairs."""
    return pairs.agg(F.max("d").alias("max_d"), F.min("d").alias("min_d"))
