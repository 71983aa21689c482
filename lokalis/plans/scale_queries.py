"""Registered queries of the plans for any number of rows, of as-of and interval joins and of projections, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.functions import projection
from lokalis.operators import dense, joins, local, models, neighbours, tiles
from lokalis.plans import catalog, model_sql
from lokalis.plans.catalog import BASIC, COUNTS, CUSTOMERS, LINE, LINE_SPEC, LINES, NAMES2, NAMES3, ONE, after, digits_of, model, off_ties, points_of, rounded, timed_sql, weighted_sql
from lokalis.plans.registry import ORACLES, put
from lokalis.sources import layers
from lokalis.sources.store import folder
from lokalis.streaming import watch, windows

#: Rows of a tile here, so that the small tables are many tiles as well.
TILE = 512

put("gw_mean_tiles", lambda s, d: tiles.means(points_of(s, d, "customer"), points_of(s, d, "customer"), ["v"], local.Spec(15), TILE).select("fid", off_ties("v_LM").alias("lm")), ORACLES["gw_mean_gaussian_fixed"])
put("gw_mean_tiles_adaptive", lambda s, d: tiles.means(points_of(s, d, "customer"), points_of(s, d, "customer"), ["v"], local.Spec(60, "tricube", True), TILE).select("fid", off_ties("v_LM").alias("lm")), ORACLES["gw_mean_tricube_adaptive"])
put("gw_quantiles_tiles", lambda s, d: rounded(tiles.quantiles(points_of(s, d, "supplier"), points_of(s, d, "supplier"), "v", local.Spec(20), tile=TILE)), ORACLES["gw_quantiles"])
put("gwr_basic_tiles", model(lambda df, s: digits_of(tiles.basic(tiles.state(df, "dep", ["a", "b"]), NAMES3, local.Spec(60, "bisquare", True), TILE)[0], BASIC)), ORACLES["gwr_basic"])
put("gtwr_tiles", model(lambda df, s: digits_of(tiles.basic(tiles.state(df.withColumn("t", F.col("fid") % 12), "dep", ["a"], "t"), NAMES2, local.Spec(30, time_scale=0.05), TILE)[0], LINE)), ORACLES["gtwr"])
put("gwr_robust_tiles", model(lambda df, s: digits_of(tiles.robust(tiles.state(df, "dep", ["a"]), NAMES2, LINE_SPEC, "iterative", 20, 1e-5, TILE)[0], {"Intercept": 3, "a": 3, "yhat": 3, "residual": 3, "Intercept_SE": 2, "a_SE": 2})), ORACLES["gwr_robust_iterative"])
put("gwr_poisson_tiles", model(lambda df, s: digits_of(tiles.generalized(tiles.state(df, "n", ["a"]), NAMES2, LINE_SPEC, "poisson", tile=TILE)[0], COUNTS)), ORACLES["gwr_poisson"])
put("gwr_future_excluded", model(lambda df, s: digits_of(models.gwr(df.withColumn("t", F.col("fid") % 12), "dep", ["a"], local.Spec(30, time_scale=0.05, future="exclude"), t="t")[0], {"Intercept": 2, "a": 2, "yhat": 2, "residual": 2})), after(timed_sql(30, 0.05).replace("AS w FROM (SELECT *, CAST", "* CASE WHEN t > ft THEN 0.0 ELSE 1.0 END AS w FROM (SELECT *, CAST").replace("SELECT f.fid AS fid, d.*", "SELECT f.fid AS fid, f.t AS ft, d.*"), model_sql.fit("w", ONE, "dep", "o"), 'SELECT fid, round(beta0,2) AS "Intercept", round(beta1,2) AS a, round(yhat,2) AS yhat, round(res,2) AS residual FROM o'))
put("gwr_through_origin", model(lambda df, s: digits_of(models.gwr(df, "dep", ["a", "b"], local.Spec(30), intercept=False)[0], {"a": 3, "b": 1, "yhat": 3, "residual": 3})), after(weighted_sql("gaussian", 30, LINES), model_sql.fit("w", ["a", "b"], "dep", "o"), "SELECT fid, round(beta0,3) AS a, round(beta1,1) AS b, round(yhat,3) AS yhat, round(res,3) AS residual FROM o"))


def ranked_sql(kernel: str, size: float, adaptive: bool) -> str:
    """Rank correlations with ranks over the whole column."""
    ranks = f"SELECT fid, x, y, CAST(row_number() OVER (ORDER BY dep, fid) AS DOUBLE) AS dep, CAST(row_number() OVER (ORDER BY a, fid) AS DOUBLE) AS a FROM ({LINES})"
    return weighted_sql(kernel, size, ranks, adaptive) + catalog.CORRELATION_SQL.format(x="dep", y="a") + "SELECT fid, round(ab/sqrt(aa*bb),4) AS rho FROM t"


def spearman(kernel: str, size: float, adaptive: bool):
    return model(lambda df, s: rounded(dense.spearman(df, df, "dep", "a", local.Spec(size, kernel, adaptive)).toDF("fid", "rho"), 4))


put("gw_spearman_bisquare", spearman("bisquare", 45, False), ranked_sql("bisquare", 45, False))
put("gw_spearman_adaptive", spearman("tricube", 50, True), ranked_sql("tricube", 50, True))

#: Half of the customers live at one place.
CLUSTERED = f"SELECT fid, CASE WHEN fid % 2 = 0 THEN 40.0 ELSE x END AS x, CASE WHEN fid % 2 = 0 THEN 40.0 ELSE y END AS y FROM ({CUSTOMERS})"


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.when(F.col("fid") % 2 == 0, 40.0).otherwise(F.col(c)).alias(c)
    return points_of(spark, sf_dir, "customer").select("fid", at("x"), at("y"))


put("nearest_by_leaves", lambda s, d: rounded(neighbours.nearest(clustered(s, d), clustered(s, d), 4, 100)), f"WITH p AS ({CLUSTERED}), q AS (SELECT f.fid, d.fid AS d_fid, sqrt({catalog.D2}) AS d FROM p f CROSS JOIN p d), r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d, d_fid) AS rank FROM q) SELECT fid, d_fid, CAST(rank AS INT) AS rank, round(d,6) AS d FROM r WHERE rank <= 4")


def last_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale with its client's last click up to then, a day back at most."""
    sales, clicks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "clicks"))
    out = joins.as_of(sales.select("sale_id", "client_id", "sold_at"), clicks.select("client_id", "ts", "click_id"), ["client_id"], "sold_at", "ts", ["click_id"], within=86400)
    return out.select("sale_id", "client_id", "sold_at", F.col("d_click_id").alias("click_id"), F.col("d_ts").alias("clicked_at"))


put("as_of_clicks", last_clicks, """WITH s AS (SELECT row_number() OVER () AS rid, sale_id, client_id, sold_at FROM sales),
c AS (SELECT client_id, ts, max(click_id) AS click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
m AS (SELECT s.rid, max(c.ts) AS ts FROM s JOIN c ON s.client_id = c.client_id AND c.ts <= s.sold_at AND c.ts >= s.sold_at - INTERVAL 1 DAY GROUP BY s.rid)
SELECT s.sale_id, s.client_id, s.sold_at, c.click_id, m.ts AS clicked_at FROM s LEFT JOIN m ON s.rid = m.rid LEFT JOIN c ON c.client_id = s.client_id AND c.ts = m.ts""")


def clicks_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, of a minute each, in the hour before each sale of their client."""
    sales, clicks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "clicks"))
    before = sales.select("sale_id", "client_id", (F.col("sold_at") - F.expr("INTERVAL 1 HOUR")).alias("since"), "sold_at")
    while_ = clicks.select("click_id", "client_id", "ts", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("until"))
    pairs = joins.overlapping(before, while_, ["client_id"], ("since", "sold_at"), ("ts", "until"))
    return pairs.groupBy("client_id", "sale_id").agg(F.count("*").alias("n"), F.min("d_click_id").alias("first_click"), F.max("d_click_id").alias("last_click"))


put("overlapping_clicks", clicks_before, """SELECT s.client_id, s.sale_id, count(*) AS n, min(c.click_id) AS first_click, max(c.click_id) AS last_click FROM sales s JOIN clicks c
ON s.client_id = c.client_id AND s.sold_at - INTERVAL 1 HOUR <= c.ts + INTERVAL 1 MINUTE AND c.ts <= s.sold_at GROUP BY ALL""")


def globe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over the globe, some beyond the zones' latitudes."""
    return points_of(spark, sf_dir, "customer").select("fid", (F.col("x") * 3.5 - 177).alias("x"), (F.col("y") * 1.8 - 85).alias("y"))


GLOBE = f"SELECT fid, x*3.5-177.0 AS x, y*1.8-85.0 AS y FROM ({CUSTOMERS})"
KRUEGER_SQL = f"""WITH g AS (SELECT *, CAST(floor((x+180)/6)+1 AS INT) AS zone FROM ({GLOBE}) WHERE abs(y) <= 84), a AS (SELECT *, radians(y) AS phi, radians(x-(zone*6.0-183.0)) AS lam FROM g),
b AS (SELECT *, sinh(atanh(sin(phi))-{projection.ECCENTRIC!r}::DOUBLE*atanh({projection.ECCENTRIC!r}::DOUBLE*sin(phi))) AS t FROM a), c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM b)
SELECT fid, zone, y < 0 AS south, round({projection.SCALE * projection.RADIUS!r}::DOUBLE*(eta{''.join(f'+{a!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)' for j, a in enumerate(projection.ALPHA, 1))})+500000.0,3) AS x,
 round({projection.SCALE * projection.RADIUS!r}::DOUBLE*(xi{''.join(f'+{a!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)' for j, a in enumerate(projection.ALPHA, 1))})+CASE WHEN y < 0 THEN 10000000.0 ELSE 0.0 END,3) AS y FROM c"""
put("project_to_zones", lambda s, d: rounded(projection.to_zones(globe(s, d)), 3), KRUEGER_SQL)
put("project_there_and_back", lambda s, d: rounded(projection.from_zones(projection.to_zones(globe(s, d)))), f"SELECT fid, round(x,6) AS x, round(y,6) AS y FROM ({GLOBE}) WHERE abs(y) <= 84")


RIDGE = {"y": 3, "yhat": 2, "residual": 2}
put("gwr_ridge_rows", model(lambda df, s: digits_of(models.ridge_gwr(df, "dep", ["a", "b"], LINE_SPEC, adjust=True), RIDGE)), after(weighted_sql("gaussian", 30, LINES), catalog.RIDGE_SQL, "SELECT fid, round(dep,3) AS y, round(beta0+beta1/sda*a+beta2/sdb*b,2) AS yhat, round(dep-(beta0+beta1/sda*a+beta2/sdb*b),2) AS residual FROM ro JOIN p USING (fid)"))


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of orders' places, from a layer written in the order of a curve."""
    where = f"{folder(spark)}/places"
    layers.write_places(points_of(spark, sf_dir, "orders"), where, 32)
    return layers.read_places(spark, where, 20, 30, 40, 45)


put("places_in_rectangle", pruned, "SELECT o_orderkey AS fid, CAST((o_orderkey*37)%101 AS DOUBLE) AS x, CAST((o_orderkey*53)%97 AS DOUBLE) AS y, o_totalprice AS v FROM orders WHERE (o_orderkey*37)%101 BETWEEN 20 AND 40 AND (o_orderkey*53)%97 BETWEEN 30 AND 45")


def late_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily clicks as a stream that gets what has arrived month by month; what comes two days behind the latest click is too late."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "kind", "value", F.date_format("arrived_at", "yyyy-MM").alias("arrived"))
    build = lambda s: windows.windowed(s, "ts", "1 day", ["kind"], {"n": F.count("*"), "total": F.sum("value")}, late="2 days")
    updates, _ = windows.in_batches(spark, clicks, "arrived", build, folder(spark))
    last = updates.groupBy("window_start", "kind").agg(F.max_by("n", "__batch").alias("n"), F.max_by("total", "__batch").alias("total"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "n", F.round("total", 2).alias("total"))


put("streaming_late_rows", late_clicks, """WITH c AS (SELECT ts, kind, value, strftime(arrived_at, '%Y-%m') AS arrived FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL),
m AS (SELECT arrived, max(max(ts)) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM c GROUP BY arrived)
SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n, round(sum(value),2) AS total FROM c JOIN m USING (arrived) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY ALL""")


def backfitting_sql(rounds: int) -> str:
    """Rounds of back-fitting of the intercept (bandwidth 40) and ``a`` (30) from a basic fit, with their hat matrices as rows (m, j)."""
    steps = [
        "w0 AS MATERIALIZED (SELECT fid, d_fid, w, CAST(1.0 AS DOUBLE) AS x FROM w)",
        "w1 AS MATERIALIZED (SELECT fid, d_fid, exp(-d*d/1800.0) AS w, a AS x FROM pq)",
        *model_sql.fit("w", ONE, "dep", "o"),
        "b0 AS MATERIALIZED (SELECT fid, beta0 AS k0, beta1 AS k1, dep, a FROM o JOIN p USING (fid))",
        "h0 AS MATERIALIZED (SELECT fid AS m, d_fid AS j, w.w*(a0_2+a0_3*w.a) AS s0, p.a*w.w*(a1_2+a1_3*w.a) AS s1 FROM w JOIN o USING (fid) JOIN p USING (fid))",
    ]
    for t in range(2 * rounds):
        k, other, last, own = t % 2, "k1*b.a" if t % 2 == 0 else "k0", f"b{t}", "1.0" if t % 2 == 0 else "p.a"
        pick = lambda name, new: ", ".join(new if i == k else f"{name}{i}" for i in range(2))  # noqa: B023, E731
        steps += [
            f"f{t + 1} AS MATERIALIZED (SELECT w{k}.fid, sum(w*x*(dep-{other}))/sum(w*x*x) AS nk FROM w{k} JOIN {last} b ON b.fid=d_fid GROUP BY w{k}.fid)",
            f"b{t + 1} AS MATERIALIZED (SELECT fid, {pick('k', f'nk AS k{k}')}, dep, a FROM {last} JOIN f{t + 1} USING (fid))",
            f"g{t + 1} AS MATERIALIZED (SELECT fid AS m, j, sum(w*x*(CASE WHEN m=j THEN 1.0 ELSE 0.0 END - s{1 - k}))/sum(w*x*x) AS ns FROM w{k} JOIN h{t} ON m=d_fid GROUP BY fid, j)",
            f"h{t + 1} AS MATERIALIZED (SELECT m, j, {pick('s', f'ns*{own} AS s{k}')} FROM h{t} JOIN g{t + 1} USING (m, j) JOIN p ON p.fid=m)",
        ]
    last = 2 * rounds
    steps += [
        f"sq AS (SELECT m AS fid, sum(s0*s0) AS q0, sum(s1*s1)/max(p.a*p.a) AS q1 FROM h{last} JOIN p ON p.fid=m GROUP BY m)",
        f"tr AS (SELECT sum(CASE WHEN m=j THEN s0+s1 END) AS s, sum(pow(s0+s1,2)) AS ss FROM h{last})",
        f"rs AS (SELECT sum(pow(dep-k0-k1*a,2)) AS rss, count(*) AS cnt FROM b{last})",
    ]
    return after(weighted_sql("gaussian", 40, LINES), steps, f"SELECT fid, round(k0,2) AS \"Intercept\", round(k1,3) AS a, round(k0+k1*a,2) AS yhat, round(dep-k0-k1*a,2) AS residual, round(sqrt(rss/(cnt-2*s+ss)*q0),2) AS \"Intercept_SE\", round(sqrt(rss/(cnt-2*s+ss)*q1),3) AS \"a_SE\", round(s,4) AS tr_s, round(ss,4) AS tr_sts FROM b{last} JOIN sq USING (fid) CROSS JOIN tr CROSS JOIN rs")


def backfitted(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Three rounds of back-fitting with given bandwidths, their errors and traces."""
    out, diag = models.multiscale_gwr(df, "dep", {"Intercept": local.Spec(40), "a": local.Spec(30)}, tol=0.0, most=3, hat=True)
    rows = digits_of(out, {"Intercept": 2, "a": 3, "yhat": 2, "residual": 2, "Intercept_SE": 2, "a_SE": 3})
    return rows.withColumn("tr_s", F.lit(round(diag["tr_s"], 4))).withColumn("tr_sts", F.lit(round(diag["tr_sts"], 4)))


put("gwr_multiscale_rounds", model(backfitted), backfitting_sql(3))


def rescanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second scan of a folder finds: two of three drops as they were, one written again with other prices, one new."""
    where, at = folder(spark), folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    drop = lambda k, times: orders.filter(F.col("o_orderkey") % 4 == k).withColumn("o_totalprice", F.col("o_totalprice") * times).write.mode("overwrite").option("header", True).csv(f"{where}/drop-{k}")
    for k in (0, 1, 2):
        drop(k, 1)
    schema = "o_orderkey bigint, o_totalprice double"
    watch.scanned(spark, where, at, schema)
    drop(1, 2)
    drop(3, 1)
    table, changes = watch.scanned(spark, where, at, schema)
    return changes.unionByName(table.withColumn("op", F.lit("=")))


put("watched_folder_changes", rescanned, """SELECT '-' AS op, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT '+', o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END * o_totalprice FROM orders WHERE o_orderkey % 4 IN (1, 3)
UNION ALL SELECT '=', o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END * o_totalprice FROM orders""")


def poisson_elsewhere(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Three rounds of the Poisson model at the lines' places, and its coefficients and means beside every other of them."""
    foci = df.filter("fid % 2 = 0").select("fid", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"), "a")
    return digits_of(models.generalized_predict(df, foci, "n", ["a"], LINE_SPEC, "poisson", 0.0, 3), {"Intercept": 5, "a": 6, "yhat": 4})


ELSEWHERE = f"WITH p AS ({LINES}), f AS (SELECT fid, x, y FROM p UNION ALL SELECT fid+1000000, x+0.5, y+0.25 FROM p WHERE fid%2=0), w AS MATERIALIZED (SELECT f.fid AS fid, d.* EXCLUDE (fid), d.fid AS d_fid, exp(-{catalog.D2}/1800.0) AS w FROM f CROSS JOIN p d)"
put("gwr_poisson_elsewhere", model(poisson_elsewhere), after(ELSEWHERE, [*model_sql.generalized("w", ONE, "n", "p", "poisson", 3, 0.0), f"el AS (SELECT fid-1000000 AS fid, {', '.join(model_sql.betas(2))} FROM i2 WHERE fid >= 1000000)"], 'SELECT fid, round(beta0,5) AS "Intercept", round(beta1,6) AS a, round(exp(beta0+beta1*p.a),4) AS yhat FROM el JOIN p USING (fid)'))
