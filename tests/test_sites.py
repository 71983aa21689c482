"""Rows of one place are met as one: the pairs grow with the places, the results are those of all rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.functions import distance as dist
from lokalis.operators import dense, local, models, pairs, summary, tiles
from lokalis.plans import catalog

N, PLACES = 600, 12


@pytest.fixture(scope="module")
def crowd(spark):
    i = np.arange(N)
    pdf = pd.DataFrame({"fid": i, "x": (i % 4).astype(float), "y": (i % 3).astype(float), "v": np.random.default_rng(3).normal(5, 1, N), "a": np.random.default_rng(4).normal(0, 1, N)})
    return spark.createDataFrame(pdf), pdf


def brute(pdf, spec):
    xy = pdf[["x", "y"]].to_numpy()
    return local.weigh(spec, local.distances(spec, xy, xy))


SPECS = [local.Spec(1.5), local.Spec(1.2, "bisquare"), local.Spec(130, "tricube", True), local.Spec(900, "exponential", True)]


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_means_meet_places(crowd, monkeypatch, spec):
    df, pdf = crowd
    W = brute(pdf, spec)
    want = W @ pdf.v / W.sum(1)
    met = []
    tiled, distances = tiles.tiled, dense.distances
    monkeypatch.setattr(tiles, "tiled", lambda f, d, *more: met.append((f.count(), d.count())) or tiled(f, d, *more))
    for plan in (lambda: dense.means(df, df, ["v"], spec), lambda: tiles.means(df, df, ["v"], spec, 5)):
        got = plan().toPandas().sort_values("fid")
        assert len(got) == N and np.allclose(got.v_LM, want)
    assert met and max(max(m) for m in met) == PLACES
    q = pairs.weighted_sums(df, df, pairs.Bandwidth(spec.size, spec.kernel, spec.adaptive), {"s": F.lit(1.0), "v": F.col("v")}).toPandas().sort_values("fid")
    assert np.allclose(q.v / q.s, want)


def test_pair_plans_meet_places_and_need_no_shuffle_of_pairs(crowd, monkeypatch):
    df, pdf = crowd
    met, all_pairs = [], pairs.all_pairs
    monkeypatch.setattr(pairs, "all_pairs", lambda f, d, *more: met.append((f.count(), d.count())) or all_pairs(f, d, *more))
    xy = pdf[["x", "y"]].to_numpy()
    d = np.abs(xy[:, None] - xy[None]).sum(2)
    got = pairs.distance_summary(df, df, dist.manhattan).toPandas().sort_values("fid")
    assert np.allclose(got.mean_d, d.mean(1)) and np.allclose(got.max_d, d.max(1)) and (got.n == N).all()
    lagged = df.withColumn("t", F.col("fid") % 2)
    got = pairs.distance_summary(lagged, lagged, lag="t", scale=0.3).toPandas().sort_values("fid")
    e = ((xy[:, None] - xy[None]) ** 2).sum(2)
    assert np.allclose(got.mean_d, np.sqrt(e + 0.3 * (pdf.fid.to_numpy()[:, None] % 2 - pdf.fid.to_numpy()[None] % 2) ** 2).mean(1))
    got = pairs.distance_summary(df, df, radius=1.1).toPandas().sort_values("fid")
    near = e <= 1.21
    assert (got.n.to_numpy() == near.sum(1)).all() and np.allclose(got.sum_d, np.sqrt(e * near).sum(1))
    w = np.exp(-e / 2 / 1.5**2)
    w /= w.sum(1, keepdims=True)
    got = summary.averages_of(df, df, ["v"], pairs.Bandwidth(1.5)).toPandas().sort_values("fid")
    assert np.allclose(got.v_LM, w @ pdf.v) and np.allclose(got.v_LVar, w @ pdf.v**2 - (w @ pdf.v) ** 2)
    got = summary.correlation_of(df, df, "v", "a", pairs.Bandwidth(1.5)).toPandas().sort_values("fid")
    assert np.allclose(got["Cov_v.a"], (w @ (pdf.v * pdf.a) - (w @ pdf.v) * (w @ pdf.a)) / (1 - (w * w).sum(1)))
    assert met and max(max(m) for m in met) <= 2 * PLACES
    plan = pairs.all_pairs(df.select("fid", "x", "y"), df.limit(5)).groupBy("fid").agg(F.sum("d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(fid") == 0 or plan.rindex("hashpartitioning(fid") > plan.index("BroadcastNestedLoopJoin")


@pytest.mark.parametrize("spec", [local.Spec(2.0), local.Spec(300, "bisquare", True)], ids=str)
def test_regression_by_tiles_meets_places(crowd, monkeypatch, spec):
    df, pdf = crowd
    W = brute(pdf, spec)
    X, y = np.column_stack([np.ones(N), pdf.a]), pdf.v.to_numpy()
    S = np.stack([X[i] @ np.linalg.solve((X * W[i][:, None]).T @ X, (X * W[i][:, None]).T) for i in range(N)])
    e = y - S @ y
    R = np.eye(N) - S
    sigma2 = (e @ e) / (N - 2 * np.trace(S) + (S * S).sum())
    met, tiled = [], tiles.tiled
    monkeypatch.setattr(tiles, "tiled", lambda f, d, *more: met.append((f.count(), d.count())) or tiled(f, d, *more))
    got = tiles.basic(tiles.state(df, "v", ["a"]), ["Intercept", "a"], spec, 5)[0].toPandas().sort_values("fid")
    assert np.allclose(got.yhat, S @ y) and np.allclose(got.Stud_residual, e / np.sqrt(sigma2 * (R * R).sum(0)))
    tss, rss = W @ (y - y.mean()) ** 2, W @ e**2
    assert np.allclose(got.localR2, (tss - rss) / tss)
    assert max(max(m) for m in met) == PLACES


def test_quantiles_by_tiles_ask_once_a_place(crowd, monkeypatch):
    df, pdf = crowd
    met, tiled = [], tiles.tiled
    monkeypatch.setattr(tiles, "tiled", lambda f, d, *more: met.append(f.select("fid").distinct().count()) or tiled(f, d, *more))
    got, want = (q(df, df, "v", local.Spec(1.5)).toPandas().sort_values("fid") for q in (tiles.quantiles, dense.quantiles))
    assert max(met) == PLACES and len(got) == N
    for c in want.columns:
        assert np.allclose(got[c], want[c]), c


@pytest.mark.parametrize("spec", [local.Spec(2.0), local.Spec(300, "bisquare", True), local.Spec(2.0, future="exclude")], ids=str)
def test_dense_fits_meet_places(crowd, monkeypatch, spec):
    df, pdf = crowd
    timed = df.withColumn("t", F.col("fid") % 2)
    t = "t" if spec.future == "exclude" else None
    p = local.points(timed, "v", ["a"], t)
    extra, noise = np.linspace(0.5, 2, N), np.linspace(1, 3, N)
    whole = local.fit_block(local.points_at(p, np.arange(N)), (spec, p, extra, noise))
    met, over = [], local.over_foci
    monkeypatch.setattr(local, "over_foci", lambda focus, *more: met.append(focus.count()) or over(focus, *more))
    got = local.local_fit(local.own_foci(timed, p), p, spec, extra, t, noise).toPandas().sort_values("fid")
    assert met == [2 * PLACES if t and PLACES % 2 else PLACES]
    for c in ("beta", "raw", "s_ii", "ss", "cv"):
        assert np.allclose(np.stack(got[c]), np.stack(whole[c])), c
    assert got.ok.all()


def test_nearest_by_rings_looks_at_few_of_a_place(crowd, monkeypatch):
    df, pdf = crowd
    met, ringed = [], pairs.ringed
    monkeypatch.setattr(pairs, "ringed", lambda f, d, *more: met.append((f.count(), d.count())) or ringed(f, d, *more))
    got = pairs.nearest(df.select("fid", "x", "y"), df, 3).toPandas()
    assert len(got) == 3 * N and max(f for f, _ in met) <= PLACES and max(d for _, d in met) <= 3 * PLACES
    first = pdf.sort_values("fid").groupby(["x", "y"]).fid.apply(lambda s: list(s)[:3])
    for (x, y), own in got.sort_values("rank").groupby(["x", "y"]):
        assert own.groupby("fid").d_fid.apply(list).tolist() == [first[x, y]] * (N // PLACES) and (own.d == 0).all()


@pytest.fixture(scope="module")
def shared(spark):
    """200 points at 20 places, some of them with one point only."""
    r = np.random.default_rng(5)
    n = 200
    pdf = pd.DataFrame({"fid": r.permutation(n), "x": r.integers(0, 4, n).astype(float), "y": r.integers(0, 4, n).astype(float), "a": r.normal(40, 1, n), "b": r.normal(0, 0.01, n)})
    pdf.loc[pdf.fid < 4, "x"] = 5.0 + pdf.fid[pdf.fid < 4]
    pdf["z"] = pdf.a * (1 + pdf.x) + r.normal(size=n)
    return spark.createDataFrame(pdf)


def systems_met(monkeypatch) -> list[int]:
    """The columns of the weights that are made from now on, on the driver's side of ``over_foci``."""
    met, whole = [], models.over_foci
    monkeypatch.setattr(models, "over_foci", lambda focus, held, f, schema, points_held, ended=None: (met.append(focus.count()), whole(focus, held, f, schema, points_held, ended))[1])
    return met


SPECS = [local.Spec(2.0), local.Spec(30, "bisquare", True), local.Spec(1.5, "tricube"), local.Spec(250, "gaussian", True)]


@pytest.mark.parametrize("spec", SPECS)
def test_component_scores_meet_places(shared, spec, monkeypatch):
    p = local.points(shared, None, ["a", "b", "z"], intercept=False)
    W = local.weights_of(spec, p, p.xy)
    np.fill_diagonal(W, 0)
    total = 0.0
    for i, w in enumerate(W):
        on = w > 0
        V = models.components_of(p.X[on], w[on], 2) if on.sum() > 1 else None
        total += math.inf if V is None else (p.X[i] - p.X[i] @ V @ V.T).sum() ** 2
    met = systems_met(monkeypatch)
    assert np.isclose(models.gwpca_cv(shared, p, spec, 2), total, rtol=1e-7) and max(met) < 30


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("leave", [False, True])
@pytest.mark.parametrize("spec", SPECS)
def test_ridge_meets_places(shared, spec, leave, adjust, monkeypatch):
    p = local.points(shared, "z", ["a", "b"])
    met = systems_met(monkeypatch)
    rows = models.ridge_rows(shared, p, spec, 0.5, adjust, 30.0, leave)
    got = models.gathered(rows)
    sd = p.X.std(0, ddof=1)
    sd[0] = 1
    X, W = p.X / sd, local.weights_of(spec, p, p.xy)
    if leave:
        np.fill_diagonal(W, 0)
    assert max(met) < 30 and list(got.fid) == list(p.fid)
    for i, w in enumerate(W):
        wx = w[:, None] * p.X
        sv = np.linalg.svd(wx / np.maximum(np.linalg.norm(wx, axis=0), 1e-300), compute_uv=False)
        cn = sv[0] / sv[-1] if sv[-1] > 0 else math.inf
        lam = (sv[0] - 30 * sv[-1]) / 29 if adjust and cn > 30 else 0.5
        A = X.T @ (w[:, None] * X) + lam * np.eye(3)
        if np.linalg.cond(A) < 1e10:
            inv = np.linalg.inv(A)
            assert np.allclose(got.beta[i], inv @ X.T @ (w * p.y) / sd, rtol=1e-6) and np.isclose(got["lambda"][i], lam, rtol=1e-8)
            C = inv @ X.T @ (w[:, None] ** 2 * X) @ inv
            assert np.allclose(got.raw[i], np.diag(C) / sd**2, rtol=1e-5) and np.isclose(got.ss[i], X[i] @ C @ X[i], rtol=1e-5) and np.isclose(got.s_ii[i], w[i] * X[i] @ inv @ X[i], rtol=1e-6)
        if not leave and cn < 1e10:
            assert np.isclose(got.condition[i], cn, rtol=1e-6)


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_component_scores_are_made_once_a_place(crowd, monkeypatch, spec):
    df, pdf = crowd
    monkeypatch.setattr(local, "MOST_POINTS", 100)  # all pairs come of the rows of places, so that more points are no matter
    X, W = pdf[["v", "a"]].to_numpy(), brute(pdf, spec)
    got = models.gwpca_scores(df, ["v", "a"], 2, spec, 9).toPandas()
    assert len(got) == (W > 0).sum()
    score = np.full((N, N, 2), np.nan)
    score[got.fid, got.d_fid] = got[["Comp.1", "Comp.2"]]
    for i in range(0, N, 37):
        on = W[i] > 0
        assert np.isnan(score[i][~on]).all() and np.allclose(score[i][on], X[on] @ models.components_of(X[on], W[i][on], 2), atol=1e-8)
    same = (got.d_fid.to_numpy()[1:] == got.d_fid.to_numpy()[:-1]).sum()
    assert same == len(got) * (1 - PLACES / N)  # a score stands behind itself for all foci of its place


@pytest.mark.parametrize("name", ["matrix_lookup", "sql_functions"])
def test_queries_of_suppliers_meet_places(spark, tmp_path, monkeypatch, name):
    """300 suppliers at 12 places, one without a balance, against the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    keys = [9797 * (k // 12) + k % 12 for k in range(300)]
    rows = [(key, None if k == 7 else round(900 - 3.17 * k, 2)) for k, key in enumerate(keys)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    met, all_pairs, small = [], pairs.all_pairs, pairs.small
    monkeypatch.setattr(pairs, "all_pairs", lambda f, d, *more: met.append((f.count(), d.count())) or all_pairs(f, d, *more))
    monkeypatch.setattr(pairs, "small", lambda d: met.append((12, d.count())) or small(d))
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas().sort_values("fid")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name]).df().sort_values("fid")[list(got.columns)]
    assert len(got) == 300 and np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-5)
    assert met and set(met) == {(12, 12)}


@pytest.mark.parametrize("criterion, k", [("CV", 70), ("AICc", 20)])
def test_scalable_of_more_points_than_tasks_hold(crowd, monkeypatch, criterion, k):
    """50 points at each place and ties between places: fewer and more neighbours than a place has; and points with places of their own. The search is left out, its score is that of given shares."""
    df, pdf = crowd
    own = pdf.assign(x=np.random.default_rng(8).uniform(0, 5, N), y=np.random.default_rng(9).uniform(0, 5, N))
    monkeypatch.setattr(models, "simplex", lambda f, start: np.array([0.7, 0.02]))
    for df in (df, df.sparkSession.createDataFrame(own)):
        want, first = models.scalable_gwr(df, "v", ["a"], k=k, criterion=criterion)
        with monkeypatch.context() as m:
            m.setattr(models, "MOST_POINTS", 100)
            m.setattr(local, "MOST_POINTS", 100)
            got, diag = models.scalable_gwr(df, "v", ["a"], k=k, criterion=criterion)
            got = got.toPandas().sort_values("fid")
        want = want.toPandas().sort_values("fid")
        assert list(got.columns) == list(want.columns) and np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-8, atol=1e-9)
        assert set(diag) == set(first) and {q: round(v, 6) for q, v in diag.items()} == {q: pytest.approx(v, abs=1e-6, rel=1e-8) for q, v in first.items()}


def test_values_at_places_of_their_order(spark):
    from lokalis.operators.models import ranked

    v = np.random.default_rng(5).lognormal(0, 9, 150_000)
    df = spark.createDataFrame(pd.DataFrame({"d": v, "n": 2})).unionByName(spark.createDataFrame([(0.0, 7), (0.0, 4)], "d double, n bigint"))
    order = np.sort(np.r_[np.zeros(11), np.repeat(v, 2)])
    at = [0, 10, 11, 150_004, 150_005, len(order) - 1]
    assert ranked(df, at) == [order[k] for k in at]


def test_foci_without_points_near_have_no_correlation_in_blocks_of_their_own(crowd, spark):
    df, _ = crowd
    far = spark.createDataFrame([(1, 500.0, 500.0)], "fid bigint, x double, y double")
    got = dense.correlations(far, df, ["v"], ["a"], local.Spec(2.5, "boxcar")).toPandas()
    assert got.drop(columns="fid").isna().all(axis=None) and len(got) == 1
