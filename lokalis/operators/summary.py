"""Local summary statistics: moments, quantiles, covariance and correlation, as aggregates of weighted pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalis.operators import pairs as met
from lokalis.sources.store import written


def averages(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Local mean, variance, standard deviation, skewness and coefficient of variation of each variable, by focus; weights are normalised."""
    sums = [F.sum("w").alias("s0")] + [F.sum(F.col("w") * F.pow(F.col(f"d_{v}"), F.lit(float(k)))).alias(f"s{k}_{v}") for v in names for k in (1, 2, 3)]
    return moments(pairs.groupBy("fid").agg(*sums), names)


def averages_of(focus: DataFrame, data: DataFrame, names: list[str], bw: met.Bandwidth) -> DataFrame:
    """``averages`` of the weighted pairs of two tables, by their places."""
    terms = {f"s{k}_{v}": F.pow(F.col(v), F.lit(float(k))) for v in names for k in (1, 2, 3)}
    return moments(met.weighted_sums(focus, data, bw, {"s0": F.lit(1.0), **terms}), names)


def moments(out: DataFrame, names: list[str]) -> DataFrame:
    cols = []
    for v in names:
        m = [F.try_divide(F.col(f"s{k}_{v}"), F.col("s0")) for k in (1, 2, 3)]
        var = F.greatest(m[1] - m[0] * m[0], F.lit(0.0))
        sd = F.sqrt(var)
        skew = F.try_divide(m[2] - 3 * m[0] * m[1] + 2 * m[0] * m[0] * m[0], sd * sd * sd)
        cols += [m[0].alias(f"{v}_LM"), sd.alias(f"{v}_LSD"), var.alias(f"{v}_LVar"), skew.alias(f"{v}_LSke"), F.try_divide(sd, m[0]).alias(f"{v}_LCV")]
    return out.select("fid", *cols)


def quantiles(pairs: DataFrame, v: str) -> DataFrame:
    """Weighted local median, interquartile range and quantile imbalance: the value just before the cumulated weight exceeds the share."""
    order = Window.partitionBy("fid").orderBy(f"d_{v}", "d_fid")
    total = Window.partitionBy("fid")
    p = pairs.filter("w > 0").withColumn("share", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(total)).withColumn("at", F.row_number().over(order))
    q = [F.coalesce(F.max_by(f"d_{v}", F.when(F.col("share") <= F.lit(k), F.col("at"))), F.min(f"d_{v}")) for k in (0.25, 0.5, 0.75)]
    out = p.groupBy("fid").agg(*(x.alias(f"q{k}") for k, x in enumerate(q)))
    iqr = F.col("q2") - F.col("q0")
    return out.select("fid", F.col("q1").alias(f"{v}_Median"), iqr.alias(f"{v}_IQR"), F.try_divide(2 * F.col("q1") - F.col("q2") - F.col("q0"), iqr).alias(f"{v}_QI"))


def correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Local covariance sum(w dx dy) / (1 - sum w^2) and correlation, weights normalised."""
    a, b, w = F.col(f"d_{x}"), F.col(f"d_{y}"), F.col("w")
    s = pairs.groupBy("fid").agg(F.sum(w).alias("s"), F.sum(w * w).alias("ww"), F.sum(w * a).alias("sx"), F.sum(w * b).alias("sy"), F.sum(w * a * a).alias("xx"), F.sum(w * b * b).alias("yy"), F.sum(w * a * b).alias("xy"))
    return correlated(s, x, y)


def correlation_of(focus: DataFrame, data: DataFrame, x: str, y: str, bw: met.Bandwidth) -> DataFrame:
    """``correlation`` of the weighted pairs of two tables, by their places."""
    a, b = F.col(x), F.col(y)
    return correlated(met.weighted_sums(focus, data, bw, {"s": F.lit(1.0), "sx": a, "sy": b, "xx": a * a, "yy": b * b, "xy": a * b}, {"ww": F.lit(1.0)}), x, y)


def correlated(s: DataFrame, x: str, y: str) -> DataFrame:
    n = F.col("s")
    scale = 1 - F.try_divide(F.col("ww"), n * n)
    cov = lambda p, i, j: F.try_divide(F.try_divide(F.col(p), n) - F.try_divide(F.col(i) * F.col(j), n * n), scale)
    r = F.try_divide(cov("xy", "sx", "sy"), F.sqrt(cov("xx", "sx", "sx") * cov("yy", "sy", "sy")))
    return s.select("fid", cov("xy", "sx", "sy").alias(f"Cov_{x}.{y}"), r.alias(f"Corr_{x}.{y}"))


def z_scores(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / sample deviation of each variable; null where the deviation is 0."""
    stats = df.agg(*(f(v).alias(f"{k}_{v}") for v in names for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*(c for c in df.columns if c not in names), *(F.try_divide(F.col(v) - F.col(f"m_{v}"), F.col(f"s_{v}")).alias(v) for v in names))


def centred(df: DataFrame, names: list[str]) -> DataFrame:
    means = df.agg(*(F.avg(v).alias(f"m_{v}") for v in names))
    out = df.crossJoin(F.broadcast(means))
    return out.select(*(c for c in df.columns if c not in names), *((F.col(v) - F.col(f"m_{v}")).alias(v) for v in names))


def layer_statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def quartile_table(df: DataFrame, names: list[str]) -> DataFrame:
    """0, 25, 50, 75 and 100 % quantiles of each column, by piecewise linear interpolation with half-step knots (type 5).

    All columns' values are sorted in ranges over many tasks and written; the ranges' sizes tell where the wanted
    places are, and only the ten values around them are read for each column.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("double").alias("value")) for v in names))).alias("e")).select("e.*").filter("value is not null")
    long = written(long.repartitionByRange("name", "value").sortWithinPartitions("name", "value").withColumn("at", F.monotonically_increasing_id()))
    pieces = sorted((r["name"], r["p"], r["first"], r["n"]) for r in long.groupBy("name", F.shiftright("at", 33).alias("p")).agg(F.min("at").alias("first"), F.count("*").alias("n")).collect())
    where: dict[int, tuple[str, int]] = {}
    total = {v: sum(n for name, _, _, n in pieces if name == v) for v in names}
    heights = {v: [min(max(total[v] * p + 0.5, 1.0), float(total[v])) for p in (0.0, 0.25, 0.5, 0.75, 1.0)] for v in names if total[v]}
    for v, hs in heights.items():
        for place in {min(int(h) + k, total[v]) for h in hs for k in (0, 1)}:
            before = 0
            for name, _, first, n in pieces:
                if name == v and before < place <= before + n:
                    where[first + place - before - 1] = (v, place)
                before += n if name == v else 0
    found = {where[r["at"]]: r["value"] for r in long.filter(F.col("at").isin(list(where))).collect()} if where else {}
    rows = []
    for v, hs in heights.items():
        low = [found[v, int(h)] for h in hs]
        rows.append((v, *(a + (h - int(h)) * (found[v, min(int(h) + 1, total[v])] - a) for a, h in zip(low, hs))))
    return df.sparkSession.createDataFrame(rows, "name string, q0 double, q1 double, q2 double, q3 double, q4 double")
