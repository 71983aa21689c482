"""Registered queries over the driver's tables, and the SQL that checks them.

The tables have no coordinates: points are derived from keys in the same way here and in SQL.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.functions import distance as dist
from lokalis.functions import kernels
from lokalis.operators import dense, local, models, pairs, rows, summary
from lokalis.plans import model_sql
from lokalis.plans.registry import ORACLES, QUERIES, put  # noqa: F401

CUSTOMERS = "SELECT c_custkey AS fid, CAST((c_custkey*37)%101 AS DOUBLE) AS x, CAST((c_custkey*53)%97 AS DOUBLE) AS y, c_acctbal AS v FROM customer"
SUPPLIERS = "SELECT s_suppkey AS fid, CAST((s_suppkey*37)%101 AS DOUBLE) AS x, CAST((s_suppkey*53)%97 AS DOUBLE) AS y, s_acctbal AS v FROM supplier"
LINES = "SELECT l_suppkey AS fid, CAST((l_suppkey*37)%101 AS DOUBLE) AS x, CAST((l_suppkey*53)%97 AS DOUBLE) AS y, avg(l_extendedprice) AS dep, avg(l_quantity) AS a, avg(l_discount) AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_suppkey"
PARTS = "SELECT p_partkey AS fid, CAST((p_partkey*37)%101 AS DOUBLE) AS x, CAST((p_partkey*53)%97 AS DOUBLE) AS y, p_retailprice AS dep, CAST(p_size AS DOUBLE) AS a FROM part"
D2 = "((f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y))"


def points_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    key = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "lineitem": "l_suppkey", "orders": "o_orderkey"}[table]
    if table == "lineitem":
        df = df.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("dep"), F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.count("*").cast("double").alias("n"))
        values = ["dep", "a", "b", "n"]
    elif table == "orders":
        values = [F.col("o_totalprice").alias("v")]
    elif table == "part":
        values = [F.col("p_retailprice").alias("dep"), F.col("p_size").cast("double").alias("a")]
    else:
        values = [F.col(f"{key[0]}_acctbal").alias("v")]
    k = F.col(key)
    return df.select(k.alias("fid"), ((k * 37) % 101).cast("double").alias("x"), ((k * 53) % 97).cast("double").alias("y"), *values)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


KERNEL_SQL = {
    "gaussian": "exp(-(d*d)/(bw*bw)/2.0)",
    "exponential": "exp(-d/bw)",
    "bisquare": "CASE WHEN d > bw THEN 0.0 ELSE (1.0-(d/bw)*(d/bw))*(1.0-(d/bw)*(d/bw)) END",
    "tricube": "CASE WHEN d > bw THEN 0.0 ELSE pow(1.0-pow(d/bw,3),3) END",
    "boxcar": "CASE WHEN d > bw THEN 0.0 ELSE 1.0 END",
}


def weighted_sql(kernel: str, size: float, points: str, adaptive: bool = False) -> str:
    """SQL text of ``w``: focus fid, data row, weight."""
    w = KERNEL_SQL[kernel]
    p = f"p AS ({points}), pq AS (SELECT f.fid AS fid, d.* EXCLUDE (fid), d.fid AS d_fid, sqrt{D2} AS d FROM p f CROSS JOIN p d)"
    b = f"r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d, d_fid) AS rk FROM pq), k AS (SELECT fid, d AS bw FROM r WHERE rk={int(size)}), w AS (SELECT pq.*, {w} AS w FROM pq JOIN k USING (fid))"
    return f"WITH {p}, " + (b if adaptive else f"w AS (SELECT *, {w} AS w FROM (SELECT *, CAST({float(size)} AS DOUBLE) AS bw FROM pq))")


MEAN_SQL = " SELECT fid, round(sum(w*v)/sum(w) + 1e-9, 6) AS lm FROM w GROUP BY fid"


def off_ties(c: str):
    """Rounded to 6 digits; means of cents lie on ties, which the order of summation would round either way."""
    return F.round(F.col(c) + 1e-9, 6)


def gw_mean(kernel: str, size: float, adaptive: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points_of(spark, sf_dir, "customer")
        return dense.means(p, p, ["v"], local.Spec(size, kernel, adaptive)).select("fid", off_ties("v_LM").alias("lm"))

    return run


for _kernel in kernels.NAMES:
    put(f"gw_mean_{_kernel}_fixed", gw_mean(_kernel, 15, False), weighted_sql(_kernel, 15, CUSTOMERS) + MEAN_SQL)
    put(f"gw_mean_{_kernel}_adaptive", gw_mean(_kernel, 60, True), weighted_sql(_kernel, 60, CUSTOMERS, True) + MEAN_SQL)


def order_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table of points: compact weights, so that a block of foci sees a strip of the points."""
    p = points_of(spark, sf_dir, "orders")
    return rounded(dense.means(p, p, ["v"], local.Spec(3, "bisquare")), 4)


put("gw_mean_orders", order_means, "WITH p AS (SELECT o_orderkey AS fid, CAST((o_orderkey*37)%101 AS DOUBLE) AS x, CAST((o_orderkey*53)%97 AS DOUBLE) AS y, o_totalprice AS v FROM orders), g AS (SELECT x, y, count(*) AS n, sum(v) AS s FROM p GROUP BY x, y), w AS (SELECT f.x, f.y, sum(n*pow(1-((f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y))/9.0,2)) AS sw, sum(s*pow(1-((f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y))/9.0,2)) AS sv FROM (SELECT DISTINCT x, y FROM p) f JOIN g d ON (f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y) <= 9.0 GROUP BY f.x, f.y) SELECT fid, round(sv/sw,4) AS \"v_LM\" FROM p JOIN w USING (x, y)")


def pair_mean(kernel: str, size: float, adaptive: bool):
    """The plan for data that is too large to broadcast."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points_of(spark, sf_dir, "supplier")
        sums = pairs.weighted_sums(p, p, pairs.Bandwidth(size, kernel, adaptive), {"s": F.lit(1.0), "v": F.col("v")})
        return sums.select("fid", (F.col("v") / F.col("s")).alias("m")).select("fid", off_ties("m").alias("lm"))

    return run


for _kernel, _size, _adaptive in (("gaussian", 15, False), ("bisquare", 15, False), ("tricube", 20, True)):
    put(f"gw_mean_pair_plan_{_kernel}", pair_mean(_kernel, _size, _adaptive), weighted_sql(_kernel, _size, SUPPLIERS, _adaptive) + MEAN_SQL)


def distance_query(metric: dist.Distance, lonlat: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points_of(spark, sf_dir, "supplier")
        p = p.withColumn("x", F.col("x") * 3.5 - 177).withColumn("y", F.col("y") * 1.2 - 57.6) if lonlat else p
        return rounded(pairs.distance_summary(p, p, metric).select("fid", "mean_d", "max_d", "min_d"))

    return run


def distance_sql(expr: str, lonlat: bool = False) -> str:
    src = f"SELECT fid, x*3.5-177.0 AS x, y*1.2-57.6 AS y FROM ({SUPPLIERS})" if lonlat else SUPPLIERS
    return f"WITH p AS ({src}), q AS (SELECT f.fid, {expr} AS d FROM p f CROSS JOIN p d) SELECT fid, round(avg(d),6) AS mean_d, round(max(d),6) AS max_d, round(min(d),6) AS min_d FROM q GROUP BY fid"


GREAT_CIRCLE_SQL = """
WITH p AS (SELECT fid, x*3.5-177.0 AS x, y*1.2-57.6 AS y FROM ({0})),
a AS (SELECT f.fid, f.x AS fx, f.y AS fy, d.x AS dx, d.y AS dy, radians(f.y+d.y)/2 AS ff, radians(f.y-d.y)/2 AS gg, radians(f.x-d.x)/2 AS ll FROM p f CROSS JOIN p d),
b AS (SELECT *, pow(sin(gg),2)*pow(cos(ll),2)+pow(cos(ff),2)*pow(sin(ll),2) AS s, pow(cos(gg),2)*pow(cos(ll),2)+pow(sin(ff),2)*pow(sin(ll),2) AS c FROM a),
e AS (SELECT *, CASE WHEN s > 0 THEN atan(sqrt(s/c)) END AS w FROM b), g AS (SELECT *, CASE WHEN w <> 0 THEN sqrt(s*c)/w END AS r FROM e),
h AS (SELECT fid, CASE WHEN fx=dx AND fy=dy OR fy=dy AND abs(fx)+abs(dx)=360 THEN 0.0 ELSE 2*w*6378.137*(1+(1/298.257223563)*((3*r-1)/(2*c)*pow(sin(ff),2)*pow(cos(gg),2)-(3*r+1)/(2*s)*pow(cos(ff),2)*pow(sin(gg),2))) END AS d FROM g)
SELECT fid, round(avg(d),6) AS mean_d, round(max(d),6) AS max_d, round(min(d),6) AS min_d FROM h GROUP BY fid
""".format(SUPPLIERS)

put("distance_euclidean", distance_query(dist.euclidean), distance_sql(f"sqrt{D2}"))
put("distance_chebyshev", distance_query(dist.by_power(1)), distance_sql("greatest(abs(f.x-d.x),abs(f.y-d.y))"))
put("distance_manhattan", distance_query(dist.by_power(-1)), distance_sql("abs(f.x-d.x)+abs(f.y-d.y)"))
put("distance_minkowski", distance_query(dist.minkowski(3)), distance_sql("pow(pow(abs(f.x-d.x),3)+pow(abs(f.y-d.y),3),1.0/3)"))
put("distance_great_circle", distance_query(dist.great_circle, True), GREAT_CIRCLE_SQL)


def local_pairs(spark: SparkSession, sf_dir: str, table: str, kernel: str = "bisquare", size: float = 40, adaptive: bool = True) -> DataFrame:
    p = points_of(spark, sf_dir, table)
    return pairs.weighted(p.select("fid", "x", "y"), p, pairs.Bandwidth(size, kernel, adaptive))


put("gw_average", lambda s, d: rounded(summary.averages_of(points_of(s, d, "supplier"), points_of(s, d, "supplier"), ["v"], pairs.Bandwidth(20)), 4), weighted_sql("gaussian", 20, SUPPLIERS) + """,
m AS (SELECT fid, sum(w*v)/sum(w) AS m1, sum(w*v*v)/sum(w) AS m2, sum(w*v*v*v)/sum(w) AS m3 FROM w GROUP BY fid)
SELECT fid, round(m1,4) AS "v_LM", round(sqrt(m2-m1*m1),4) AS "v_LSD", round(m2-m1*m1,4) AS "v_LVar", round((m3-3*m1*m2+2*m1*m1*m1)/pow(m2-m1*m1,1.5),4) AS "v_LSke", round(sqrt(m2-m1*m1)/m1,4) AS "v_LCV" FROM m""")
put("gw_quantiles", lambda s, d: rounded(dense.quantiles(points_of(s, d, "supplier"), points_of(s, d, "supplier"), "v", local.Spec(20))), weighted_sql("gaussian", 20, SUPPLIERS) + """,
c AS (SELECT fid, v, sum(w) OVER (PARTITION BY fid ORDER BY v, d_fid ROWS UNBOUNDED PRECEDING)/sum(w) OVER (PARTITION BY fid) AS s, row_number() OVER (PARTITION BY fid ORDER BY v, d_fid) AS k FROM w),
q AS (SELECT fid, coalesce(max_by(v,k) FILTER (WHERE s<=0.25), min(v)) AS q0, coalesce(max_by(v,k) FILTER (WHERE s<=0.5), min(v)) AS q1, coalesce(max_by(v,k) FILTER (WHERE s<=0.75), min(v)) AS q2 FROM c GROUP BY fid)
SELECT fid, round(q1,6) AS "v_Median", round(q2-q0,6) AS "v_IQR", round(CASE WHEN q2<>q0 THEN (2*q1-q2-q0)/(q2-q0) END,6) AS "v_QI" FROM q""")
CORRELATION_SQL = """, c AS (SELECT fid, w, {x} AS a, {y} AS b FROM w), s AS (SELECT fid, sum(w) AS s, sum(w*w) AS ww, sum(w*a) AS sa, sum(w*b) AS sb, sum(w*a*a) AS aa, sum(w*b*b) AS bb, sum(w*a*b) AS ab FROM c GROUP BY fid),
t AS (SELECT fid, 1-ww/(s*s) AS k, ab/s-sa*sb/(s*s) AS ab, aa/s-sa*sa/(s*s) AS aa, bb/s-sb*sb/(s*s) AS bb FROM s) """
put("gw_correlation", lambda s, d: rounded(summary.correlation_of(points_of(s, d, "lineitem"), points_of(s, d, "lineitem"), "dep", "a", pairs.Bandwidth(20)).toDF("fid", "cov", "corr"), 4), weighted_sql("gaussian", 20, LINES) + CORRELATION_SQL.format(x="dep", y="a") + "SELECT fid, round(ab/k,4) AS cov, round(ab/sqrt(aa*bb),4) AS corr FROM t")
put("gw_spearman", lambda s, d: rounded(dense.spearman(points_of(s, d, "lineitem"), points_of(s, d, "lineitem"), "dep", "a", local.Spec(20)).toDF("fid", "rho"), 4), (weighted_sql("gaussian", 20, LINES) + CORRELATION_SQL.format(x="dep", y="a") + "SELECT fid, round(ab/sqrt(aa*bb),4) AS rho FROM t").replace("SELECT fid, w, dep AS a, a AS b FROM w", "SELECT fid, w, CAST(row_number() OVER (PARTITION BY fid ORDER BY dep, d_fid)-1 AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY fid ORDER BY a, d_fid)-1 AS DOUBLE) AS b FROM w"))
put("nearest_neighbours", lambda s, d: rounded(dense.nearest(points_of(s, d, "supplier"), points_of(s, d, "supplier"), 5)), f"WITH p AS ({SUPPLIERS}), q AS (SELECT f.fid, d.fid AS d_fid, sqrt{D2} AS d FROM p f CROSS JOIN p d), r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d, d_fid) AS rank FROM q) SELECT fid, d_fid, rank, round(d,6) AS d FROM r WHERE rank <= 5")
put("grid_range_join", lambda s, d: pairs.distance_summary(points_of(s, d, "customer"), points_of(s, d, "customer"), radius=4.0).select("fid", "n", F.round("sum_d", 6).alias("sum_d")), f"WITH p AS ({CUSTOMERS}) SELECT f.fid, count(*) AS n, round(sum(sqrt{D2}),6) AS sum_d FROM p f JOIN p d ON sqrt{D2} <= 4.0 GROUP BY f.fid")
put("layer_statistics", lambda s, d: summary.layer_statistics(points_of(s, d, "customer")), f"SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ({CUSTOMERS})")
put("z_scores", lambda s, d: rounded(summary.z_scores(points_of(s, d, "customer"), ["v"]).select("fid", "v")), f"SELECT fid, round((v-avg(v) OVER ())/stddev_samp(v) OVER (),6) AS v FROM ({CUSTOMERS})")
put("centred", lambda s, d: rounded(summary.centred(points_of(s, d, "customer"), ["v"]).select("fid", "v")), f"SELECT fid, round(v-avg(v) OVER (),6) AS v FROM ({CUSTOMERS})")
put("filter_expression", lambda s, d: rows.where(points_of(s, d, "customer"), rows.combined("v > 1000", "x < 50", "and")), f"SELECT * FROM ({CUSTOMERS}) WHERE v > 1000 AND x < 50")
put("filter_rectangle", lambda s, d: rows.in_box(points_of(s, d, "customer"), 10, 10, 40, 60), f"SELECT * FROM ({CUSTOMERS}) WHERE x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 60")
put("select_invert", lambda s, d: rows.inverted(rows.select_rows(points_of(s, d, "supplier"), "v > 5000")), f"SELECT *, NOT (v > 5000) AS selected FROM ({SUPPLIERS})")
put("field_calculator", lambda s, d: rounded(rows.calculated(points_of(s, d, "supplier"), "v", "v / 100 + x", "y < 50")), f"SELECT fid, x, y, round(CASE WHEN y < 50 THEN v/100+x ELSE v END,6) AS v FROM ({SUPPLIERS})")
put("reproject_mercator", lambda s, d: rounded(rows.to_mercator(points_of(s, d, "supplier").withColumn("y", F.col("y") * 0.8).select("fid", "x", "y")), 3), f"SELECT fid, round(6378137.0*radians(x),3) AS x, round(6378137.0*ln(tan(0.7853981633974483+radians(y*0.8)/2)),3) AS y FROM ({SUPPLIERS})")
put("quartile_table", lambda s, d: rounded(summary.quartile_table(points_of(s, d, "supplier"), ["v"])), f"""WITH r AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n, lead(v) OVER (ORDER BY v) AS nx FROM ({SUPPLIERS})),
h AS (SELECT *, p, least(greatest(n*p+0.5,1.0),n) AS h FROM r CROSS JOIN (VALUES (0.0),(0.25),(0.5),(0.75),(1.0)) AS t(p)), g AS (SELECT p, v+(h-floor(h))*(coalesce(nx,v)-v) AS q FROM h WHERE k=floor(h))
SELECT 'v' AS name, round(max(q) FILTER (WHERE p=0.0),6) AS q0, round(max(q) FILTER (WHERE p=0.25),6) AS q1, round(max(q) FILTER (WHERE p=0.5),6) AS q2, round(max(q) FILTER (WHERE p=0.75),6) AS q3, round(max(q) FILTER (WHERE p=1.0),6) AS q4 FROM g""")

MOMENTS_SQL = """, s AS (SELECT fid, sum(w) AS s0, sum(w*a) AS s1, sum(w*a*a) AS s2, sum(w*dep) AS t0, sum(w*a*dep) AS t1, sum(w*w) AS b0, sum(w*w*a) AS b1, sum(w*w*a*a) AS b2 FROM w GROUP BY fid),
g AS (SELECT *, s0*s2-s1*s1 AS det FROM s),
o AS (SELECT g.*, p.a AS xa, p.dep AS yy, (s2*t0-s1*t1)/det AS beta0, (s0*t1-s1*t0)/det AS beta1, (s2-2*p.a*s1+p.a*p.a*s0)/det AS sii,
 (pow(s2-p.a*s1,2)*b0+2*(s2-p.a*s1)*(p.a*s0-s1)*b1+pow(p.a*s0-s1,2)*b2)/(det*det) AS ss, (s0-1)*(s2-p.a*p.a)-(s1-p.a)*(s1-p.a) AS d1 FROM g JOIN p USING (fid)),
e AS (SELECT *, yy-beta0-beta1*xa AS res, yy-(((s2-xa*xa)*(t0-yy)-(s1-xa)*(t1-xa*yy))+xa*((s0-1)*(t1-xa*yy)-(s1-xa)*(t0-yy)))/d1 AS cv FROM o) """
LINE_SPEC = local.Spec(30, "gaussian")


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points_of(spark, sf_dir, "lineitem")
    return rounded(models.gwr_predict(df, df.select("fid", "x", "y"), "dep", ["a"], LINE_SPEC).select("fid", F.col("Intercept").alias("beta0"), F.col("a").alias("beta1")), 4)


def pair_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points_of(spark, sf_dir, "lineitem")
    return rounded(models.coefficients_by_pairs(df, df, "dep", ["a"], pairs.Bandwidth(30)).select("fid", F.col("Intercept").alias("beta0"), F.col("a").alias("beta1")), 4)


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([{k: float(v) for k, v in values.items() if isinstance(v, (int, float))}]))


def model(f: Callable[[DataFrame, SparkSession], DataFrame], table: str = "lineitem"):
    return lambda spark, sf_dir: f(points_of(spark, sf_dir, table), spark)


def multiscale(df: DataFrame, spark: SparkSession) -> DataFrame:
    out, diag = models.multiscale_gwr(df, "dep", {"Intercept": local.Spec(40), "a": local.Spec(30)}, select=True, hat=True)
    return out.withColumn("rounds", F.lit(diag["rounds"])).withColumn("converged", F.lit(diag["converged"]))


put("gwr_coefficients", coefficients, weighted_sql("gaussian", 30, LINES) + MOMENTS_SQL + "SELECT fid, round(beta0,4) AS beta0, round(beta1,4) AS beta1 FROM e")
put("gwr_coefficients_pair_plan", pair_coefficients, ORACLES["gwr_coefficients"])
put("gwr_diagnostics", model(lambda df, s: rounded(one_row(s, models.gwr(df, "dep", ["a"], LINE_SPEC)[1]).select((F.col("rss") / 1000).alias("rss"), "tr_s", "tr_sts", "aicc"), 3)), weighted_sql("gaussian", 30, LINES) + MOMENTS_SQL + "SELECT round(sum(res*res)/1000,3) AS rss, round(sum(sii),3) AS tr_s, round(sum(ss),3) AS tr_sts, round(count(*)*ln(sum(res*res)/count(*))+count(*)*ln(2*pi())+count(*)*(count(*)+sum(sii))/(count(*)-2-sum(sii)),3) AS aicc FROM e")
put("gwr_cv_score", model(lambda df, s: rounded(one_row(s, {"cv": models.score(df, local.points(df, "dep", ["a"]), LINE_SPEC)}), 2)), weighted_sql("gaussian", 30, LINES) + MOMENTS_SQL + "SELECT round(sum(cv*cv),2) AS cv FROM e")
put("ols", model(lambda df, s: (lambda o: rounded(s.createDataFrame([(float(o["beta"][0]), float(o["beta"][1]), float(o["r2"]))], "intercept double, slope double, r2 double"), 4))(models.ols_of(df, "dep", ["a"]))), f"SELECT round(regr_intercept(dep,a),4) AS intercept, round(regr_slope(dep,a),4) AS slope, round(regr_r2(dep,a),4) AS r2 FROM ({LINES})")
XS3, ONE = ["1.0", "a", "b"], ["1.0", "a"]
NAMES3, NAMES2 = ["Intercept", "a", "b"], ["Intercept", "a"]


def result_digits(names: list[str], beta: int, local_r2: bool = True) -> dict[str, int]:
    """Digits that summation in another order leaves alone, by result column."""
    out = {n: beta for n in names} | {"y": 3, "yhat": 3, "residual": 3, "Stud_residual": 5} | {f"{n}_SE": beta - 1 for n in names} | {f"{n}_TV": 5 for n in names}
    return out | {"localR2": 6} if local_r2 else out


def digits_of(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select("fid", *(F.round(F.col(f"`{c}`"), d).alias(c) for c, d in digits.items()))


def after(text: str, ctes: list[str], select: str) -> str:
    return f"{text}, {', '.join(ctes)} {select}"


def timed_sql(size: float, scale: float) -> str:
    """Gaussian weights over space-time distances; the time is the id's remainder."""
    return weighted_sql("gaussian", size, f"SELECT *, CAST(fid%12 AS DOUBLE) AS t FROM ({LINES})").replace(f"sqrt{D2} AS d", f"sqrt({D2}+{scale}*(f.t-d.t)*(f.t-d.t)) AS d")


BASIC = result_digits(NAMES3, 1)
LINE = result_digits(NAMES2, 3)
put("gwr_basic", model(lambda df, s: digits_of(models.gwr(df, "dep", ["a", "b"], local.Spec(60, "bisquare", True))[0], BASIC)), after(weighted_sql("bisquare", 60, LINES, True), model_sql.full("w", XS3, "dep", "o", NAMES3), model_sql.rounded("o", BASIC)))
put("gwr_line", model(lambda df, s: digits_of(models.gwr(df, "dep", ["a"], LINE_SPEC)[0], LINE)), after(weighted_sql("gaussian", 30, LINES), model_sql.full("w", ONE, "dep", "o", NAMES2), model_sql.rounded("o", LINE)))
put("gtwr", model(lambda df, s: digits_of(models.gwr(df.withColumn("t", F.col("fid") % 12), "dep", ["a"], local.Spec(30, time_scale=0.05), t="t")[0], LINE)), after(timed_sql(30, 0.05), model_sql.full("w", ONE, "dep", "o", NAMES2), model_sql.rounded("o", LINE)))


def score_rows(df: DataFrame, spark: SparkSession) -> DataFrame:
    rows = models.bandwidth_scores(df, "dep", ["a"], local.Spec(0, "bisquare", True), list(range(30, 101, 10)))
    return spark.createDataFrame([(b, round(cv / 1000, 3), round(a, 4)) for b, cv, a in rows], "bandwidth double, cv double, aicc double")


SCORE_SQL = " UNION ALL ".join(f"SELECT {b}.0::DOUBLE AS bandwidth, * FROM ({after(weighted_sql('bisquare', b, LINES, True), model_sql.fit('w', ONE, 'dep', 'o'), 'SELECT round(sum(cv*cv)/1000,3) AS cv, round(count(*)*ln(sum(res*res)/count(*))+count(*)*ln(2*pi())+count(*)*(count(*)+sum(s_ii))/(count(*)-2-sum(s_ii)),4) AS aicc FROM o')})" for b in range(30, 101, 10))
put("gwr_bandwidth_scores", model(score_rows), SCORE_SQL)


def search_rows(spark: SparkSession, trace: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(b, round(v / 1000, 3)) for b, v in trace], "bandwidth double, score double")


put("gwr_bandwidth_search", model(lambda df, s: search_rows(s, models.select_bandwidth(df, local.points(df, "dep", ["a"]), local.Spec(0, "bisquare", True))[1])), model_sql.golden(LINES, ONE, "dep", 20, "count(*)"))


def subset_sql(names: list[str]) -> str:
    """AICc of the global model of these variables."""
    xs = ["1.0", *names]
    k = len(xs)
    hat = model_sql.added(f"beta{i}*({x})" for i, x in enumerate(xs))
    ctes = [f"p AS ({LINES})", "w AS (SELECT 0 AS fid, 1.0::DOUBLE AS w, p.* EXCLUDE (fid) FROM p)", model_sql.moments("w", xs, "dep", "m", False), *model_sql.inverse("m", k, "i"), f"r AS (SELECT count(*) AS c, sum(pow(dep-{hat},2)) AS rss FROM p CROSS JOIN (SELECT {', '.join(model_sql.betas(k))} FROM i))"]
    return f"SELECT '{','.join(sorted(names))}' AS s, aicc FROM (WITH {', '.join(ctes)} SELECT c*ln(rss/c)+c*ln(2*pi())+c*(c+{k})/(c-2-{k}) AS aicc FROM r)"


SELECTION_SQL = "WITH z AS MATERIALIZED (" + " UNION ALL ".join(subset_sql(list(c)) for n in (1, 2, 3) for c in itertools.combinations(["a", "b", "n"], n)) + """),
l1 AS (SELECT s AS f FROM z WHERE length(s)=1 ORDER BY aicc LIMIT 1), l2 AS (SELECT f, replace(replace(s, f, ''), ',', '') AS g FROM z, l1 WHERE length(s)=3 AND contains(s, f) ORDER BY aicc LIMIT 1)
SELECT s AS model, round(aicc,4) AS aicc FROM z WHERE length(s)=1 UNION ALL SELECT f || ',' || replace(replace(s, f, ''), ',', ''), round(aicc,4) FROM z, l1 WHERE length(s)=3 AND contains(s, f)
UNION ALL SELECT f || ',' || g || ',' || replace(replace(replace(s, f, ''), g, ''), ',', ''), round(aicc,4) FROM z, l2 WHERE length(s)=5"""
put("gwr_variable_selection", model(lambda df, s: s.createDataFrame([(",".join(m), round(float(a), 4)) for m, a in models.forward_selection(df, "dep", ["a", "b", "n"])[1]], "model string, aicc double")), SELECTION_SQL)
MASKED = ["rw AS MATERIALIZED (SELECT e.* REPLACE (e.w*CASE WHEN abs(\"Stud_residual\") <= 3 THEN 1.0 ELSE 0.0 END AS w) FROM w e JOIN o ON e.d_fid = o.fid)"]
put("gwr_robust_filter", model(lambda df, s: digits_of(models.robust_gwr(df, "dep", ["a"], LINE_SPEC)[0].drop("localR2"), result_digits(NAMES2, 3, False))), after(weighted_sql("gaussian", 30, LINES), [*model_sql.full("w", ONE, "dep", "o", NAMES2), *MASKED, *model_sql.full("rw", ONE, "dep", "o2", NAMES2)], model_sql.rounded("o2", result_digits(NAMES2, 3, False))))
put("gwr_robust_iterative", model(lambda df, s: digits_of(models.robust_gwr(df, "dep", ["a"], LINE_SPEC, "iterative")[0], {"Intercept": 3, "a": 3, "yhat": 3, "residual": 3, "Intercept_SE": 2, "a_SE": 2})), after(weighted_sql("gaussian", 30, LINES), [*model_sql.robust("w", ONE, "dep", "p"), *model_sql.full("rw", ONE, "dep", "o", NAMES2)], model_sql.rounded("o", {"Intercept": 3, "a": 3, "yhat": 3, "residual": 3, "Intercept_SE": 2, "a_SE": 2})))
RIDGE_SQL = [
    "sd AS MATERIALIZED (SELECT stddev_samp(a) AS sda, stddev_samp(b) AS sdb FROM p)",
    "nm AS MATERIALIZED (SELECT fid, sum(w*w) AS n0, sum(w*w*a*a) AS n1, sum(w*w*b*b) AS n2, sum(w*w*a) AS c01, sum(w*w*b) AS c02, sum(w*w*a*b) AS c12 FROM w GROUP BY fid)",
    "cm AS MATERIALIZED (SELECT fid, 1.0::DOUBLE AS m0_0, 1.0::DOUBLE AS m1_1, 1.0::DOUBLE AS m2_2, c01/sqrt(n0*n1) AS m0_1, c02/sqrt(n0*n2) AS m0_2, c12/sqrt(n1*n2) AS m1_2 FROM nm)",
    *model_sql.eigen3("cm", "ce"),
    "lm AS MATERIALIZED (SELECT fid AS l_fid, sqrt(e1/e3) AS condition, CASE WHEN sqrt(e1/e3) > 30 THEN (sqrt(e1)-30*sqrt(e3))/29 ELSE 0.0 END AS lam FROM ce)",
    "ws AS MATERIALIZED (SELECT fid, w, dep, a/sda AS a, b/sdb AS b FROM w CROSS JOIN sd)",
    model_sql.moments("ws", XS3, "dep", "rm", False),
    "rl AS MATERIALIZED (SELECT * REPLACE (m0_0+lam AS m0_0, m1_1+lam AS m1_1, m2_2+lam AS m2_2) FROM rm JOIN lm ON fid = l_fid)",
    *model_sql.inverse("rl", 3, "ri"),
    f"ro AS MATERIALIZED (SELECT fid, condition, lam, {', '.join(model_sql.betas(3))}, sda, sdb FROM ri CROSS JOIN sd)",
]
put("gwr_ridge", model(lambda df, s: digits_of(models.ridge_gwr(df, "dep", ["a", "b"], LINE_SPEC, adjust=True), {"Intercept": 2, "a": 2, "b": 2, "lambda": 6, "condition": 3})), after(weighted_sql("gaussian", 30, LINES), RIDGE_SQL, 'SELECT fid, round(beta0,2) AS "Intercept", round(beta1/sda,2) AS a, round(beta2/sdb,2) AS b, round(lam,6) AS "lambda", round(condition,3) AS condition FROM ro'))
COUNTS = {"Intercept": 5, "a": 6, "yhat": 4, "residual": 4}
FLAGS = f"SELECT *, CAST(v > 4500 AS DOUBLE) AS z, x/100.0 AS u FROM ({SUPPLIERS})"
put("gwr_poisson", model(lambda df, s: digits_of(models.generalized_gwr(df, "n", ["a"], LINE_SPEC)[0], COUNTS)), after(weighted_sql("gaussian", 30, LINES), model_sql.generalized("w", ONE, "n", "p", "poisson", 20, 1e-5), 'SELECT fid, round(beta0,5) AS "Intercept", round(beta1,6) AS a, round(mu,4) AS yhat, round(yy-mu,4) AS residual FROM gl'))
put("gwr_binomial", model(lambda df, s: digits_of(models.generalized_gwr(df.withColumn("z", (F.col("v") > 4500).cast("double")).withColumn("u", F.col("x") / 100), "z", ["u"], local.Spec(40), "binomial")[0], {"Intercept": 5, "u": 5, "yhat": 6, "residual": 6}), "supplier"), after(weighted_sql("gaussian", 40, FLAGS), model_sql.generalized("w", ["1.0", "u"], "z", "p", "binomial", 20, 1e-5), 'SELECT fid, round(beta0,5) AS "Intercept", round(beta1,5) AS u, round(mu,6) AS yhat, round(yy-mu,6) AS residual FROM gl'))
GTDR_SQL = f"WITH p AS ({LINES}), w AS MATERIALIZED (SELECT f.fid AS fid, d.* EXCLUDE (fid), d.fid AS d_fid, exp(-pow(f.a-d.a,2)/2)*exp(-pow((f.b-d.b)/0.01,2)/2) AS w FROM p f CROSS JOIN p d)"
GTDR = {"Intercept": 1, "a": 2, "b": 0, "yhat": 2, "residual": 2}
put("gtdr", model(lambda df, s: digits_of(models.gtdr(df, "dep", ["a", "b"], [local.Spec(1.0), local.Spec(0.01)]), GTDR)), after(GTDR_SQL, model_sql.fit("w", XS3, "dep", "o"), 'SELECT fid, round(beta0,1) AS "Intercept", round(beta1,2) AS a, round(beta2,0) AS b, round(yhat,2) AS yhat, round(res,2) AS residual FROM o'))
VARIABLES = ["dep", "a", "b"]
PCA = {"Comp.1_PV": 6, "Comp.2_PV": 8, "local_CP": 6}


def pca_sql(robust: bool) -> list[str]:
    """Covariances of the weighted variables, their eigenvalues, and the first component by its dominating variable."""
    v = enumerate(VARIABLES)
    if robust:
        centre = ["ct AS MATERIALIZED (SELECT fid AS c_fid, " + ", ".join(f"arg_min({x}, struct_pack(d := abs(w-0.5), f := d_fid)) AS z{i}" for i, x in v) + " FROM w GROUP BY fid)"]
        rows = ["zz AS MATERIALIZED (SELECT fid, " + ", ".join(f"({x}-z{i})*w AS y{i}" for i, x in enumerate(VARIABLES)) + " FROM w JOIN ct ON fid = c_fid)", "zm AS MATERIALIZED (SELECT fid AS g_fid, " + ", ".join(f"avg(y{i}) AS g{i}" for i in range(3)) + " FROM zz GROUP BY fid)"]
        cov = ["pm AS MATERIALIZED (SELECT fid, " + ", ".join(f"sum((y{i}-g{i})*(y{j}-g{j})) AS m{i}_{j}" for i in range(3) for j in range(3)) + " FROM zz JOIN zm ON fid = g_fid GROUP BY fid)"]
        return [*centre, *rows, *cov, *model_sql.eigen3("pm", "pe")]
    centre = ["ct AS MATERIALIZED (SELECT fid AS c_fid, sum(w) AS sw, " + ", ".join(f"sum(w*{x})/sum(w) AS z{i}" for i, x in v) + " FROM w GROUP BY fid)"]
    cov = ["pm AS MATERIALIZED (SELECT fid, " + ", ".join(f"sum(w*({VARIABLES[i]}-z{i})*({VARIABLES[j]}-z{j}))/max(sw) AS m{i}_{j}" for i in range(3) for j in range(3)) + " FROM w JOIN ct ON fid = c_fid GROUP BY fid)"]
    return [*centre, *cov, *model_sql.eigen3("pm", "pe")]


# the first component is an eigenvector: two of its elements over the one of the variable that dominates all others
LOADINGS = ["ld AS MATERIALIZED (SELECT *, ((e1-m2_2)*m0_1+m0_2*m1_2)/((e1-m1_1)*(e1-m2_2)-m1_2*m1_2) AS t1, ((e1-m1_1)*m0_2+m0_1*m1_2)/((e1-m1_1)*(e1-m2_2)-m1_2*m1_2) AS t2 FROM pe)", "ln AS MATERIALIZED (SELECT fid, 1/sqrt(1+t1*t1+t2*t2) AS l0, t1/sqrt(1+t1*t1+t2*t2) AS l1, t2/sqrt(1+t1*t1+t2*t2) AS l2 FROM ld)"]
PCA_SELECT = "SELECT fid, round(100*e1/(3*eq),6) AS \"Comp.1_PV\", round(100*e2/(3*eq),8) AS \"Comp.2_PV\", round(100*(e1+e2)/(3*eq),6) AS \"local_CP\", 'dep' AS \"win_var_PC1\" FROM pe"


def components(robust: bool):
    return model(lambda df, s: (lambda out: digits_of(out, PCA).join(out.select("fid", "win_var_PC1"), "fid"))(models.gwpca(df, VARIABLES, 2, LINE_SPEC, robust=robust)))


put("gwpca", components(False), after(weighted_sql("gaussian", 30, LINES), pca_sql(False), PCA_SELECT))
put("gwpca_robust", components(True), after(weighted_sql("gaussian", 30, LINES), pca_sql(True), PCA_SELECT))
put("gwpca_glyphs", model(lambda df, s: rounded(models.glyphs(models.gwpca(df, VARIABLES, 2, LINE_SPEC), df, VARIABLES), 5)), after(weighted_sql("gaussian", 30, LINES), [*pca_sql(False), *LOADINGS], "SELECT p.fid, variable, p.x, p.y, round(p.x+10*abs(l)*sin(k*2*pi()/3),5) AS to_x, round(p.y+10*abs(l)*cos(k*2*pi()/3),5) AS to_y FROM (SELECT fid, 0 AS k, 'dep' AS variable, l0 AS l FROM ln UNION ALL SELECT fid, 1, 'a', l1 FROM ln UNION ALL SELECT fid, 2, 'b', l2 FROM ln) JOIN p USING (fid)"))
put("gwpca_scores", model(lambda df, s: models.gwpca_scores(df, VARIABLES, 1, LINE_SPEC, 3).withColumnRenamed("Comp.1", "score")), after(weighted_sql("gaussian", 30, LINES), [*pca_sql(False), *LOADINGS], "SELECT w.fid, w.d_fid, round(dep*l0+a*l1+b*l2,3) AS score FROM w JOIN ln ON ln.fid = w.fid"))
put("gwpca_bandwidth", model(lambda df, s: s.createDataFrame(models.gwpca_bandwidth(df, VARIABLES, 2, local.Spec(0, "bisquare", True))[1], "bandwidth double, score double")))


def pair_scores(df: DataFrame, spark: SparkSession) -> DataFrame:
    rows = models.bandwidth_scores(df, "dep", ["a"], local.Spec(0), [15, 25, 40], intercept=False)
    return spark.createDataFrame([(b, round(cv / 1000, 3), round(a, 4)) for b, cv, a in rows], "bandwidth double, cv double, aicc double")


SCORES = "SELECT round(sum(cv*cv)/1000,3) AS cv, round(count(*)*ln(sum(res*res)/count(*))+count(*)*ln(2*pi())+count(*)*(count(*)+sum(s_ii))/(count(*)-2-sum(s_ii)),4) AS aicc FROM o"
put("gw_correlation_bandwidth_scores", model(pair_scores), " UNION ALL ".join(f"SELECT {b}.0::DOUBLE AS bandwidth, * FROM ({after(weighted_sql('gaussian', b, LINES), model_sql.fit('w', ['a'], 'dep', 'o'), SCORES)})" for b in (15, 25, 40)))
put("gw_correlation_bandwidth", model(lambda df, s: search_rows(s, models.correlation_bandwidth(df, "a", "dep", local.Spec(0, "bisquare", True))[1])), model_sql.golden(LINES, ["a"], "dep", 20, "count(*)"))


def ridge_scores(df: DataFrame, spark: SparkSession) -> DataFrame:
    p = local.points(df, "dep", ["a", "b"])
    return spark.createDataFrame([(float(b), round(models.ridge_cv(df, p, local.Spec(b), 0.5) / 1000, 3)) for b in (20, 30, 45)], "bandwidth double, cv double")


LEFT_OUT = [
    "sd AS MATERIALIZED (SELECT stddev_samp(a) AS sda, stddev_samp(b) AS sdb FROM p)",
    "ws AS MATERIALIZED (SELECT fid, w, dep, a/sda AS a, b/sdb AS b FROM w CROSS JOIN sd WHERE fid <> d_fid)",
    model_sql.moments("ws", XS3, "dep", "rm", False),
    "rl AS MATERIALIZED (SELECT * REPLACE (m0_0+0.5 AS m0_0, m1_1+0.5 AS m1_1, m2_2+0.5 AS m2_2) FROM rm)",
    *model_sql.inverse("rl", 3, "ri"),
    f"ro AS MATERIALIZED (SELECT fid, {', '.join(model_sql.betas(3))} FROM ri)",
]
put("gwr_ridge_scores", model(ridge_scores), " UNION ALL ".join(f"SELECT {b}.0::DOUBLE AS bandwidth, * FROM ({after(weighted_sql('gaussian', b, LINES), LEFT_OUT, 'SELECT round(sum(pow(dep-beta0-beta1*a/sda-beta2*b/sdb,2))/1000,3) AS cv FROM ro JOIN p USING (fid) CROSS JOIN sd')})" for b in (20, 30, 45)))
RIDGE_DIAGNOSTICS = [x.replace("WHERE fid <> d_fid", "") for x in LEFT_OUT[:2]] + [model_sql.moments("ws", XS3, "dep", "rm"), *LEFT_OUT[3:-1]] + [f"ro AS MATERIALIZED (SELECT q.*, dep, {', '.join(model_sql.betas(3))}, CAST(1.0 AS DOUBLE) AS x0, p.a/sda AS x1, p.b/sdb AS x2 FROM ri q JOIN p USING (fid) CROSS JOIN sd)", f"rg AS MATERIALIZED (SELECT *, {', '.join(model_sql.added(f'a{i}_{3 + j}*x{j}' for j in range(3)) + f' AS g{i}' for i in range(3))} FROM ro)"]
put("gwr_ridge_diagnostics", model(lambda df, s: rounded(one_row(s, models.ridge_diagnostics(df, "dep", ["a", "b"], local.Spec(30), 0.5)).select((F.col("rss") / 1000).alias("rss"), "tr_s", "tr_sts"), 3)), after(weighted_sql("gaussian", 30, LINES), RIDGE_DIAGNOSTICS, "SELECT round(sum(pow(dep-beta0-beta1*x1-beta2*x2,2))/1000,3) AS rss, round(sum(" + model_sql.added(f"x{i}*g{i}" for i in range(3)) + "),3) AS tr_s, round(sum(" + model_sql.added(f"g{p}*b{p}_{q}*g{q}" for p in range(3) for q in range(3)) + "),3) AS tr_sts FROM rg"))


def generalized_diagnostics(df: DataFrame, spark: SparkSession) -> DataFrame:
    g = models.generalized_gwr(df, "n", ["a"], LINE_SPEC)[1]
    return spark.createDataFrame([(round(g["log_likelihood"], 4), round(g["deviance"], 4), round(g["null_deviance"], 4), round(g["pseudo_r2"], 6))], "log_likelihood double, deviance double, null_deviance double, pseudo_r2 double")


POISSON_DEVIANCE = "sum(CASE WHEN yy <> 0 THEN 2*(yy*(ln(yy/{0})-1)+{0}) ELSE 2*{0} END)"
put("gwr_poisson_diagnostics", model(generalized_diagnostics), after(weighted_sql("gaussian", 30, LINES), [*model_sql.generalized("w", ONE, "n", "p", "poisson", 20, 1e-5), f"dv AS (SELECT sum(yy*ln(mu)-mu-lgamma(yy+1)) AS ll, {POISSON_DEVIANCE.format('mu')} AS dev, {POISSON_DEVIANCE.format('my')} AS nul FROM gl CROSS JOIN (SELECT avg(n) AS my FROM p))"], "SELECT round(ll,4) AS log_likelihood, round(dev,4) AS deviance, round(nul,4) AS null_deviance, round(1-dev/nul,6) AS pseudo_r2 FROM dv"))


def poisson_scores(df: DataFrame, spark: SparkSession) -> DataFrame:
    p = local.points(df, "n", ["a"])
    return spark.createDataFrame([(float(b), round(models.generalized_cv(df, p, local.Spec(b)), 3)) for b in (20, 30, 45)], "bandwidth double, cv double")


put("gwr_poisson_scores", model(poisson_scores), " UNION ALL ".join(f"SELECT {b}.0::DOUBLE AS bandwidth, * FROM ({after(weighted_sql('gaussian', b, LINES), ['wl AS MATERIALIZED (SELECT * FROM w WHERE fid <> d_fid)', *model_sql.generalized('wl', ONE, 'n', 'p', 'poisson', 20, 1e-5)], 'SELECT round(sum(pow(yy-mu,2)),3) AS cv FROM gl')})" for b in (20, 30, 45)))
TESTS_SQL = [
    *model_sql.fit("w", ONE, "dep", "o"),
    "tt AS MATERIALIZED (SELECT fid, d_fid, CASE WHEN fid=d_fid THEN 1.0 ELSE 0.0 END - w*(g0+g1*a) AS t, w*(a0_2+a0_3*a) AS c0, w*(a1_2+a1_3*a) AS c1, dep FROM w JOIN o USING (fid))",
    "rr AS MATERIALIZED (SELECT u.d_fid AS i, v.d_fid AS j, sum(u.t*v.t) AS r, sum(u.c0*v.c0) AS q0, sum(u.c1*v.c1) AS q1 FROM tt u JOIN tt v USING (fid) GROUP BY u.d_fid, v.d_fid)",
    "gg AS (SELECT sum(CASE WHEN i=j THEN r END) AS g1, sum(r*r) AS g2 FROM rr)",
    "ol AS MATERIALIZED (SELECT count(*) AS cnt, avg(a) AS ma, sum(pow(a,2))-count(*)*pow(avg(a),2) AS sa, regr_slope(dep,a) AS s1, regr_intercept(dep,a) AS s0 FROM p)",
    "ors AS (SELECT sum(pow(dep-s0-s1*a,2)) AS rss0 FROM p CROSS JOIN ol)",
    "lrs AS (SELECT sum(res*res) AS rss FROM o)",
    "vv AS (SELECT sum(CASE WHEN i=j THEN h END) AS v1, sum(h*h) AS v2 FROM (SELECT i, j, CASE WHEN i=j THEN 1.0 ELSE 0.0 END - 1.0/cnt - (pi_.a-ma)*(pj.a-ma)/sa - r AS h FROM rr JOIN p pi_ ON pi_.fid=i JOIN p pj ON pj.fid=j CROSS JOIN ol))",
    "cc AS MATERIALIZED (SELECT d_fid, avg(c0) AS k0, avg(c1) AS k1 FROM tt GROUP BY d_fid)",
    "qq AS MATERIALIZED (SELECT i, j, (q0-cnt*x.k0*y.k0)/cnt AS q0, (q1-cnt*x.k1*y.k1)/cnt AS q1 FROM rr JOIN cc x ON x.d_fid=i JOIN cc y ON y.d_fid=j CROSS JOIN ol)",
    "tq AS (SELECT sum(CASE WHEN i=j THEN q0 END) AS t0, sum(q0*q0) AS u0, sum(CASE WHEN i=j THEN q1 END) AS t1, sum(q1*q1) AS u1 FROM qq)",
    "bv AS (SELECT var_pop(beta0) AS v0, var_pop(beta1) AS vb FROM o)",
    "al AS (SELECT * FROM gg, ol, ors, lrs, vv, tq, bv)",
]
TESTS_SELECT = """SELECT test, round(f,6) AS f, round(df1,5) AS df1, round(df2,5) AS df2 FROM (
SELECT 'F1' AS test, rss/g1/(rss0/(cnt-2)) AS f, g1*g1/g2 AS df1, CAST(cnt-2 AS DOUBLE) AS df2 FROM al UNION ALL SELECT 'F2', (rss0-rss)/v1/(rss0/(cnt-2)), v1*v1/v2, cnt-2 FROM al
UNION ALL SELECT 'F3_Intercept', v0/t0/(rss/g1), t0*t0/u0, g1*g1/g2 FROM al UNION ALL SELECT 'F3_a', vb/t1/(rss/g1), t1*t1/u1, g1*g1/g2 FROM al UNION ALL SELECT 'F4', rss/rss0, g1, cnt-2 FROM al)"""


def test_rows(df: DataFrame, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in models.f_tests(df, "dep", ["a"], LINE_SPEC).items()], "test string, f double, df1 double, df2 double, p double")


put("f_tests", model(test_rows))
put("f_test_statistics", model(lambda df, s: test_rows(df, s).select("test", F.round("f", 6).alias("f"), F.round("df1", 5).alias("df1"), F.round("df2", 5).alias("df2"))), after(weighted_sql("gaussian", 30, LINES), TESTS_SQL, TESTS_SELECT))


def glm_row(df: DataFrame, spark: SparkSession) -> DataFrame:
    g = models.glm_of(df, "n", ["a"], "poisson")
    return spark.createDataFrame([(round(float(g["beta"][0]), 6), round(float(g["beta"][1]), 7), round(g["deviance"], 4), round(g["null_deviance"], 4), round(g["aic"], 4))], "intercept double, a double, deviance double, null_deviance double, aic double")


DEVIANCE = "sum(CASE WHEN yy <> 0 THEN 2*(yy*(ln(yy/mu)-1)+mu) ELSE 2*mu END)"
put("glm_poisson", model(glm_row), f"WITH p AS ({LINES}), {', '.join(model_sql.generalized(None, ONE, 'n', 'p', 'poisson', 25, 1e-8, 0.1))} SELECT round(min(beta0),6) AS intercept, round(min(beta1),7) AS a, round({DEVIANCE},4) AS deviance, (SELECT round({DEVIANCE.replace('mu', '(SELECT avg(n) FROM p)')},4) FROM gl) AS null_deviance, round({DEVIANCE}+4,4) AS aic FROM gl")
put("gwr_multiscale", model(multiscale))
put("gwr_scalable", model(lambda df, s: models.scalable_gwr(df, "dep", ["a"])[0]))


def local_subset_sql(names: list[str]) -> str:
    """AICc of the local model of these variables."""
    return f"SELECT '{','.join(sorted(names))}' AS s, aicc FROM ({after(weighted_sql('gaussian', 30, LINES), model_sql.fit('w', ['1.0', *names], 'dep', 'o'), 'SELECT count(*)*ln(sum(res*res)/count(*))+count(*)*ln(2*pi())+count(*)*(count(*)+sum(s_ii))/(count(*)-2-sum(s_ii)) AS aicc FROM o')})"


put("gwr_local_variable_selection", model(lambda df, s: s.createDataFrame([(",".join(m), round(float(a), 3)) for m, a in models.local_selection(df, "dep", ["a", "b", "n"], LINE_SPEC)[1]], "model string, aicc double")), ("WITH z AS MATERIALIZED (" + " UNION ALL ".join(local_subset_sql(list(c)) for n in (1, 2, 3) for c in itertools.combinations(["a", "b", "n"], n)) + SELECTION_SQL[SELECTION_SQL.index("),\nl1 AS"):]).replace("round(aicc,4)", "round(aicc,3)"))


def timed_scores(df: DataFrame, spark: SparkSession) -> DataFrame:
    rows = models.bandwidth_scores(df.withColumn("t", F.col("fid") % 12), "dep", ["a"], local.Spec(0, time_scale=0.05), [20, 30, 45], t="t")
    return spark.createDataFrame([(b, round(cv / 1000, 3), round(a, 4)) for b, cv, a in rows], "bandwidth double, cv double, aicc double")


put("gtwr_bandwidth_scores", model(timed_scores), " UNION ALL ".join(f"SELECT {b}.0::DOUBLE AS bandwidth, * FROM ({after(timed_sql(b, 0.05), model_sql.fit('w', ONE, 'dep', 'o'), SCORES)})" for b in (20, 30, 45)))
PAIR_SIZES = {("dep", "a"): 20, ("dep", "b"): 35}
put("gw_correlations", model(lambda df, s: rounded(dense.correlations(df, df, ["dep"], ["a", "b"], {k: local.Spec(v) for k, v in PAIR_SIZES.items()}).toDF("fid", "cov_a", "corr_a", "cov_b", "corr_b"), 4)), "SELECT * FROM (" + ") JOIN (".join(weighted_sql("gaussian", v, LINES) + CORRELATION_SQL.format(x=x, y=y) + f"SELECT fid, round(ab/k,4) AS cov_{y}, round(ab/sqrt(aa*bb),4) AS corr_{y} FROM t" for (x, y), v in PAIR_SIZES.items()) + ") USING (fid)")
put("nearest_by_rings", lambda s, d: rounded(pairs.nearest(points_of(s, d, "customer").select("fid", "x", "y"), points_of(s, d, "customer"), 4).select("fid", "d_fid", "rank", "d")), f"WITH p AS ({CUSTOMERS}), q AS (SELECT f.fid, d.fid AS d_fid, sqrt{D2} AS d FROM p f CROSS JOIN p d), r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d, d_fid) AS rank FROM q) SELECT fid, d_fid, rank, round(d,6) AS d FROM r WHERE rank <= 4")

from lokalis.plans import format_queries, scale_queries, source_queries  # noqa: E402, F401
