import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.functions import distance as dist
from lokalis.functions import kernels
from lokalis.operators import dense, local, models, pairs, rows, summary


@pytest.fixture(scope="module")
def grid(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"fid": range(25), "x": [k % 5 for k in range(25)], "y": [k // 5 for k in range(25)]}).astype({"x": float, "y": float})
    pdf["a"] = r.normal(size=25)
    pdf["b"] = r.normal(size=25)
    pdf["exact"] = 1 + 2 * pdf.a
    pdf["z"] = 1 + 2 * pdf.a + pdf.x * pdf.b + r.normal(size=25) * 0.1
    return spark.createDataFrame(pdf), pdf


def test_exact_line_is_found_everywhere(grid):
    df, pdf = grid
    out, diag = models.gwr(df, "exact", ["a"], local.Spec(2.0))
    got = out.toPandas()
    assert np.allclose(got.Intercept, 1) and np.allclose(got.a, 2) and diag["rss"] < 1e-18


def test_boxcar_of_all_points_is_ols(grid):
    df, pdf = grid
    out, diag = models.gwr(df, "z", ["a", "b"], local.Spec(100.0, "boxcar"))
    o = models.ols(local.points(df, "z", ["a", "b"]))
    got = out.toPandas()
    assert np.allclose(got[["Intercept", "a", "b"]], o["beta"]) and math.isclose(diag["tr_s"], 3) and math.isclose(diag["rss"], o["rss"])


@pytest.mark.parametrize("kernel", kernels.NAMES)
@pytest.mark.parametrize("adaptive", [False, True])
def test_hat_matrix_sums_against_dense(grid, kernel, adaptive):
    df, pdf = grid
    spec = local.Spec(12 if adaptive else 3.0, kernel, adaptive)
    p = local.points(df, "z", ["a"])
    f = models.fitted(df, p, spec)
    W = local.weights_of(spec, p, p.xy)
    S = np.stack([x @ np.linalg.inv((p.X * w[:, None]).T @ p.X) @ (p.X * w[:, None]).T for x, w in zip(p.X, W)])
    assert np.allclose(f.s_ii, np.diag(S)) and np.allclose(f.ss, (S * S).sum(1))
    work = models.SecondPass()
    work.block(pd.DataFrame({"fid": p.fid, "x": p.xy[:, 0], "y": p.xy[:, 1]}), (spec, p, None, p.y))
    q = next(work.ended()).q
    assert np.allclose(q, ((np.eye(25) - S) ** 2).sum(0))
    loo = []
    for i in range(25):
        w = W[i].copy()
        w[i] = 0
        loo.append(p.y[i] - p.X[i] @ np.linalg.solve((p.X * w[:, None]).T @ p.X, (p.X * w[:, None]).T @ p.y))
    assert np.allclose(f.cv, loo)


def test_pair_plan_equals_dense_engine(grid):
    df, pdf = grid
    for bw, spec in ((pairs.Bandwidth(2.5, "bisquare"), local.Spec(2.5, "bisquare")), (pairs.Bandwidth(8, "tricube", True), local.Spec(8, "tricube", True))):
        got = pairs.weighted(df.select("fid", "x", "y"), df, bw).groupBy("fid").agg((F.sum(F.col("w") * F.col("d_z")) / F.sum("w")).alias("m")).toPandas().sort_values("fid")
        p = local.points(df, "z", [])
        W = local.weights_of(spec, p, p.xy)
        assert np.allclose(got.m, W @ p.y / W.sum(1))


def test_adaptive_edges(spark):
    df = spark.createDataFrame([(k, float(k // 2), 0.0, float(k)) for k in range(6)], "fid long, x double, y double, v double")
    for size in (1, 6, 12):
        w = pairs.weighted(df.select("fid", "x", "y"), df, pairs.Bandwidth(size, "bisquare", True)).toPandas()
        assert w.w.between(0, 1).all() and len(w) == 36


def test_great_circle_edges(spark):
    pts = [(10.0, 20.0, 10.0, 20.0), (180.0, 5.0, -180.0, 5.0), (0.0, 0.0, 180.0, 0.0), (0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    d = [r[0] for r in df.select(dist.great_circle(*map(F.col, "abcd"))).collect()]
    assert d[0] == 0 and d[1] == 0 and abs(d[3] - 111.32) < 0.1


def test_singular_fits_are_flagged(spark):
    df = spark.createDataFrame([(k, float(k), 0.0, 1.0, float(k)) for k in range(8)], "fid long, x double, y double, a double, z double")
    f = models.fitted(df, local.points(df, "z", ["a"]), local.Spec(3.0))
    assert not f.ok.any() and models.score(df, local.points(df, "z", ["a"]), local.Spec(3.0)) == math.inf


def test_golden_section_finds_a_minimum():
    best, trace = local.golden(lambda b: (b - 37) ** 2, 20, 100, True)
    assert abs(best - 37) <= 2 and all(b == int(b) for b, _ in trace)
    best, _ = local.golden(lambda b: (b - 3.3) ** 2, 0, 10, False)
    assert abs(best - 3.3) < 0.05


def test_f_distribution():
    assert abs(models.f_cdf(1.0, 5, 5) - 0.5) < 1e-12 and abs(models.f_cdf(4.0, 2, 10) - (1 - (10 / 18) ** 5)) < 1e-12


def test_families(grid, spark):
    df, pdf = grid
    counts = df.withColumn("n", F.floor(F.exp(F.lit(1.0) + 0.3 * F.col("a"))).cast("double"))
    out, diag = models.generalized_gwr(counts, "n", ["a"], local.Spec(1000.0, "boxcar"))
    g = models.glm(local.points(counts, "n", ["a"]), "poisson")
    assert np.allclose(out.toPandas()[["Intercept", "a"]], g["beta"], atol=1e-3) and diag["tr_s"] > 1.9


def test_other_models_run(grid):
    df, pdf = grid
    assert models.robust_gwr(df, "z", ["a"], local.Spec(3.0))[0].count() == 25
    assert models.scalable_gwr(df, "exact", ["a"], k=10)[1]["score"] < 1e-6
    assert models.multiscale_gwr(df, "exact", {"Intercept": local.Spec(100.0, "boxcar"), "a": local.Spec(100.0, "boxcar")})[1]["rss"] < 1e-6
    assert models.gtdr(df, "exact", ["a"], [local.Spec(5.0)]).filter("abs(a - 2) < 1e-8").count() == 25
    ridge = models.ridge_gwr(df, "exact", ["a"], local.Spec(100.0, "boxcar")).toPandas()
    assert np.allclose(ridge.a, 2)
    pick, tried = models.forward_selection(df, "z", ["a", "b"])
    assert len(tried) == 3 and pick[0] == "a"
    pca = models.gwpca(df, ["a", "b"], 2, local.Spec(100.0, "boxcar")).toPandas()
    v = np.linalg.eigvalsh(np.cov(pdf[["a", "b"]].T))
    assert np.allclose(pca["Comp.1_PV"], 100 * v[1] / v.sum())


@pytest.mark.parametrize("spec", [local.Spec(2.5, "bisquare"), local.Spec(3.0), local.Spec(8, "tricube", True), local.Spec(2.0, "boxcar", metric="manhattan")])
def test_dense_summaries_equal_the_pair_plans(grid, monkeypatch, spec):
    df, pdf = grid
    queries = [lambda: dense.means(df, df, ["a", "z"], spec), lambda: dense.quantiles(df, df, "z", spec), lambda: dense.nearest(df, df, 4)]
    if spec.kernel == "gaussian":
        queries.append(lambda: dense.spearman(df, df, "a", "z", spec))
    for q in queries:
        blocked = q().toPandas()
        with monkeypatch.context() as m:
            m.setattr(dense, "small", lambda data: False)
            plan = q().toPandas()
        key = ["fid", "rank"] if "rank" in blocked else ["fid"]
        a, b = (x.sort_values(key).to_numpy(float) for x in (blocked, plan))
        assert np.allclose(a, b, equal_nan=True)


def test_rings_find_the_nearest(spark, monkeypatch):
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"fid": range(400), "x": np.r_[r.normal(0, 1, 380), r.uniform(-300, 300, 20)], "y": np.r_[r.normal(0, 1, 380), r.uniform(-300, 300, 20)], "v": r.normal(size=400)})
    pdf.loc[50:59, ["x", "y"]] = pdf.loc[40, ["x", "y"]].to_numpy()  # equal places
    df = spark.createDataFrame(pdf)
    d = np.hypot(*(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy()[None, :] for c in "xy"))
    got = pairs.nearest(df.select("fid", "x", "y"), df, 7).toPandas().sort_values(["fid", "rank"])
    assert got.d_fid.tolist() == np.lexsort((np.broadcast_to(np.arange(400), d.shape), d))[:, :7].ravel().tolist()
    assert pairs.nearest(df.limit(3).select("fid", "x", "y"), df.limit(2), 5).count() == 6 and pairs.nearest(df, df.limit(0), 5).count() == 0
    for kernel in ("bisquare", "boxcar"):
        bw = pairs.Bandwidth(9, kernel, True)
        whole = pairs.weighted(df.select("fid", "x", "y"), df, bw).groupBy("fid").agg(F.sum(F.col("w") * F.col("d_v")).alias("s"), F.sum("w").alias("w")).toPandas().sort_values("fid")
        with monkeypatch.context() as m:
            m.setattr(pairs, "BROADCAST_POINTS", 10)
            ringed = pairs.weighted(df.select("fid", "x", "y"), df, bw).groupBy("fid").agg(F.sum(F.col("w") * F.col("d_v")).alias("s"), F.sum("w").alias("w")).toPandas().sort_values("fid")
        assert np.allclose(whole.to_numpy(float), ringed.to_numpy(float))


def test_coefficients_beyond_the_dense_bound(grid, monkeypatch):
    df, pdf = grid
    for spec in (local.Spec(3.0), local.Spec(2.5, "bisquare"), local.Spec(12, "tricube", True)):
        a = models.gwr_predict(df, df, "z", ["a", "b"], spec).toPandas().sort_values("fid")
        with monkeypatch.context() as m:
            m.setattr(models, "MOST_POINTS", 10)
            b = models.gwr_predict(df, df, "z", ["a", "b"], spec).toPandas().sort_values("fid")
        assert a.columns.tolist() == b.columns.tolist() and np.allclose(a.drop(columns="ok").to_numpy(float), b.drop(columns="ok").to_numpy(float))


def test_robust_weights_follow_the_mean_squared_residual(grid):
    df, pdf = grid
    p, spec = local.points(df, "z", ["a"]), local.Spec(3.0)
    W = local.weights_of(spec, p, p.xy)
    mask, mse = np.ones(25), None
    for _ in range(21):
        beta = np.stack([np.linalg.solve((p.X * (w * mask)[:, None]).T @ p.X, (p.X * (w * mask)[:, None]).T @ p.y) for w in W])
        res = p.y - (beta * p.X).sum(1)
        old, mse = mse, (res**2).mean()
        r = np.abs(res) / np.sqrt(mse)
        mask = np.where(r <= 2, 1, np.where(r < 3, (1 - (r - 2) ** 2) ** 2, 0))
        if old is not None and abs(old - mse) / mse <= 1e-5:
            break
    got = models.robust_gwr(df, "z", ["a"], spec, "iterative")[0].toPandas().sort_values("fid")
    assert np.allclose(got[["Intercept", "a"]], beta)


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_generalized_errors_and_deviance_against_dense(grid, family):
    df, pdf = grid
    data = df.withColumn("n", (F.floor(F.exp(F.lit(1.0) + 0.3 * F.col("a"))) if family == "poisson" else (F.col("a") + F.col("b") > 0)).cast("double"))
    spec = local.Spec(4.0)
    out, diag = models.generalized_gwr(data, "n", ["a"], spec, family)
    p = local.points(data, "n", ["a"])
    W, mu, eta, v, last = local.weights_of(spec, p, p.xy), None, None, np.ones(25), 0.0
    for _ in range(20):
        mu, z, _ = models.family_step(family, p.y, eta)
        C = np.stack([np.linalg.inv((p.X * (w * v)[:, None]).T @ p.X) @ (p.X * (w * v)[:, None]).T for w in W])
        used, eta = v, np.einsum("np,npm,m->n", p.X, C, z)
        mu, _, v = models.family_step(family, p.y, eta)
        ll = models.log_likelihood(family, p.y, mu)
        if abs((last - ll) / ll) < 1e-5:
            break
        last = ll
    se = np.sqrt(np.einsum("npm,m,npm->np", C, 1 / used, C))
    got = out.toPandas().sort_values("fid")
    assert np.allclose(got[["Intercept_SE", "a_SE"]], se) and np.allclose(got.yhat, mu)
    dev = sum(2 * (y * (math.log(y / m) - 1) + m) if y else 2 * m for y, m in zip(p.y, mu)) if family == "poisson" else sum(-2 * math.log(m if y else 1 - m) for y, m in zip(p.y, mu))
    trace = np.einsum("np,npn->", p.X, C)
    assert math.isclose(diag["deviance"], dev) and math.isclose(diag["aic"], dev + 2 * trace) and math.isclose(diag["tr_s"], trace)


@pytest.mark.parametrize("kernel", ["gaussian", "exponential"])
@pytest.mark.parametrize("criterion", ["CV", "AICc"])
def test_scalable_against_dense(grid, kernel, criterion):
    df, pdf = grid
    out, diag = models.scalable_gwr(df, "z", ["a"], k=10, kernel=kernel, criterion=criterion)
    p = local.points(df, "z", ["a"])
    d = np.hypot(*(p.xy[:, None, k] - p.xy[None, :, k] for k in (0, 1)))
    band = np.median(np.sort(d, 1)[:, 9]) / {"gaussian": math.sqrt(3), "exponential": 3.0}[kernel]
    r = np.array([diag["scale"] ** (q + 1) for q in range(5)])
    r = r / r.sum()
    W = np.full((25, 25), diag["penalty"])
    for i in range(25):
        near = np.lexsort((np.arange(25), np.where(np.arange(25) == i, -1, d[i])))[:10]
        g = np.exp(-((d[i, near] / band) ** 2))
        W[i, near] += sum(x * g**e for x, e in zip(r, (0, 2, 1, 0.5, 0.25)))
    C = np.stack([np.linalg.inv((p.X * w[:, None]).T @ p.X) @ (p.X * w[:, None]).T for w in W])
    S = np.einsum("np,npm->nm", p.X, C)
    res = p.y - S @ p.y
    got = out.toPandas().sort_values("fid")
    assert np.allclose(got[["Intercept", "a"]], C @ p.y) and math.isclose(diag["tr_s"], np.trace(S)) and math.isclose(diag["rss"], (res**2).sum())
    sigma = (res**2).sum() / (25 - 2 * np.trace(S) + (S * S).sum())
    assert np.allclose(got[["Intercept_SE", "a_SE"]], np.sqrt(sigma * (C * C).sum(2)))


def test_ridge_hat_and_cv_against_dense(grid):
    df, pdf = grid
    p, spec, lam = local.points(df, "z", ["a", "b"]), local.Spec(3.0), 0.4
    W, sd = local.weights_of(spec, p, p.xy), np.r_[1.0, p.X[:, 1:].std(0, ddof=1)]
    X = p.X / sd
    solved = lambda w: np.linalg.solve((X * w[:, None]).T @ X + lam * np.eye(3), (X * w[:, None]).T)
    S = np.stack([x @ solved(w) for x, w in zip(X, W)])
    d = models.ridge_diagnostics(df, "z", ["a", "b"], spec, lam)
    assert math.isclose(d["tr_s"], np.trace(S)) and math.isclose(d["tr_sts"], (S * S).sum()) and math.isclose(d["rss"], ((p.y - S @ p.y) ** 2).sum())
    out = [p.y[i] - X[i] @ solved(np.where(np.arange(25) == i, 0, W[i])) @ p.y for i in range(25)]
    assert math.isclose(models.ridge_cv(df, p, spec, lam), np.square(out).sum())
    assert 1.0 <= models.ridge_bandwidth(df, "z", ["a", "b"], spec, lam, limits=(1.0, 6.0))[0] <= 6.0
    assert 1.0 <= models.correlation_bandwidth(df, "a", "z", spec, "AICc", (1.0, 6.0))[0] <= 6.0


def test_component_scores_and_cv_against_dense(grid):
    df, pdf = grid
    p, spec = local.points(df, None, ["a", "b", "z"], intercept=False), local.Spec(3.0)
    W = local.weights_of(spec, p, p.xy)
    got = models.gwpca_scores(df, ["a", "b", "z"], 2, spec).toPandas()
    one = got[got.fid == 7].sort_values("d_fid")[["Comp.1", "Comp.2"]].to_numpy()
    assert len(got) == 625 and np.allclose(np.abs(one), np.abs(p.X @ models.components_of(p.X, W[7], 2)))
    total = 0.0
    for i in range(25):
        w = np.where(np.arange(25) == i, 0, W[i])
        c = np.cov(p.X.T, aweights=w, ddof=0)
        v = np.linalg.eigh(c)[1][:, ::-1][:, :2]
        total += (p.X[i] - p.X[i] @ v @ v.T).sum() ** 2
    assert math.isclose(models.gwpca_cv(df, p, spec, 2), total, rel_tol=1e-9)


def test_multiscale_hat_matrix_gives_the_fit(grid):
    df, pdf = grid
    specs = {"Intercept": local.Spec(3.0), "a": local.Spec(2.0)}
    out, diag = models.multiscale_gwr(df, "z", specs, most=40, hat=True)
    again, other = models.multiscale_gwr(df.withColumn("z", F.col("z") * 3), "z", specs, most=40, hat=True)
    assert math.isclose(diag["tr_s"], other["tr_s"], rel_tol=1e-6) and 2 < diag["tr_s"] < 25 and (out.toPandas()[["Intercept_SE", "a_SE"]] > 0).all().all()
    # one bandwidth for all and everything in reach: the global fit
    whole = models.multiscale_gwr(df, "z", {"Intercept": local.Spec(100.0, "boxcar"), "a": local.Spec(100.0, "boxcar")}, hat=True)[1]
    assert math.isclose(whole["tr_s"], 2, abs_tol=1e-4)


def test_density_bandwidths_lower_the_error(grid):
    df, _ = grid
    p = local.points(df, "z", ["a", "b"])
    start = [local.Spec(0.4), local.Spec(0.4)]
    found, cv = models.gtdr_bandwidths(df, "z", ["a", "b"], start, rounds=2, limits=[(0.3, 4.0), (0.3, 4.0)])
    assert cv < models.gtdr_cv(df, p, start) and math.isclose(cv, models.gtdr_cv(df, p, found))
    W = np.exp(-((p.X[:, None, 1] - p.X[None, :, 1]) ** 2) / 2 / 0.16) * np.exp(-((p.X[:, None, 2] - p.X[None, :, 2]) ** 2) / 2 / 0.16)
    loo = [p.y[i] - p.X[i] @ np.linalg.solve((p.X * w[:, None]).T @ p.X, (p.X * w[:, None]).T @ p.y) for i, w in enumerate(W * (1 - np.eye(25)))]
    assert math.isclose(models.gtdr_cv(df, p, start), np.square(loo).sum(), rel_tol=1e-6)


def test_scalable_bandwidth_is_of_all_points(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"fid": range(2600), "x": np.r_[r.uniform(0, 1, 1250), r.uniform(0, 90, 1350)], "y": r.uniform(0, 1, 2600), "a": r.normal(size=2600)})
    pdf["z"] = 1 + 2 * pdf.a + r.normal(size=2600)
    d = np.hypot(*(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy()[None, :] for c in "xy"))
    band = models.scalable_gwr(spark.createDataFrame(pdf), "z", ["a"], k=50)[1]["band"]
    assert math.isclose(band, np.median(np.sort(d, 1)[:, 49]) / math.sqrt(3))


def test_multiscale_tells_whether_it_converged(grid):
    df, _ = grid
    specs = {"Intercept": local.Spec(3.0), "b": local.Spec(3.0)}
    assert not models.multiscale_gwr(df, "z", specs, most=1)[1]["converged"]
    diag = models.multiscale_gwr(df, "z", specs, select=True)[1]
    assert diag["converged"] == (diag["change"] <= 1e-6) and set(diag["bandwidths"].values()) != {3.0}


def test_f4_is_the_share_of_the_global_residuals(grid):
    df, _ = grid
    f, d1, d2, q = models.f_tests(df, "z", ["a"], local.Spec(3.0))["F4"]
    rss = models.gwr(df, "z", ["a"], local.Spec(3.0))[1]["rss"]
    assert math.isclose(f, rss / models.ols(local.points(df, "z", ["a"]))["rss"]) and d2 == 23 and 0 < d1 < 25 and math.isclose(q, models.f_cdf(f, d1, d2))


def test_row_edits(grid):
    df, _ = grid
    assert rows.combined("a", "b", "or") == "(a) OR (b)"
    assert rows.calculated(df, "k", "row_number * 2").filter("k = (fid + 1) * 2").count() == 25
    assert rows.without_selected(rows.select_rows(df, "fid < 5")).count() == 20
    back = rows.from_mercator(rows.to_mercator(df)).toPandas().sort_values("fid")
    assert np.allclose(back.x, [k % 5 for k in range(25)])
    assert summary.quartile_table(df, ["x"]).first()["q2"] == 2


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_generalized_coefficients_elsewhere(grid, family):
    df, pdf = grid
    df = df.withColumn("n", F.when(F.lit(family == "poisson"), F.col("fid") % 5).otherwise(F.col("fid") % 2).cast("double"))
    spec = local.Spec(3.0)
    fit = models.generalized_gwr(df, "n", ["a"], spec, family)[0].toPandas().sort_values("fid")
    same = models.generalized_predict(df, df, "n", ["a"], spec, family).toPandas().sort_values("fid")
    for c in ("Intercept", "a", "yhat"):
        assert np.allclose(same[c], fit[c])
    far = df.limit(1).select("fid", F.lit(1e6).alias("x"), F.lit(0.0).alias("y"))
    row = models.generalized_predict(df, far, "n", ["a"], spec, family).first()
    assert row.Intercept is None and not row.ok and "yhat" not in row.asDict()
    assert models.generalized_predict(df.filter("false"), far, "n", ["a"], spec, family).count() == 0


def test_reports_hold_the_quartile_table(spark, grid, tmp_path):
    from lokalis.sources import layers

    df, _ = grid
    out, diag = models.gwr(df, "z", ["a"], local.Spec(3.0))
    text = layers.report("Local regression", diag, models.ols_of(df, "z", ["a"]), ["Intercept", "a"], {"kernel": "gaussian", "bandwidth": 3.0}, summary.quartile_table(out, ["Intercept", "a"]))
    layers.save_report(spark, str(tmp_path / "r.txt"), text)
    lines = (tmp_path / "r.txt").read_text().splitlines()
    assert lines[:2] == ["Local regression", "================"] and "kernel     gaussian" in lines
    low, high = out.agg(F.min("a"), F.max("a")).first()
    row = next(v.split() for v in lines[lines.index("Coefficients") :] if v.startswith("a "))
    assert row == ["a", f"{low:.6f}", *row[2:5], f"{high:.6f}"] and sorted(map(float, row[1:])) == list(map(float, row[1:]))
    assert layers.report("T", {"n": 1}) == "T\n=\nn  1\n"
