"""Blocked sums over hat matrices against the matrices themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.operators import hats, local, models


@pytest.fixture(scope="module")
def places(spark):
    r = np.random.default_rng(8)
    n = 170
    pdf = pd.DataFrame({"fid": r.permutation(n) * 3, "x": r.integers(0, 15, n).astype(float), "y": r.integers(0, 12, n).astype(float), "a": r.normal(size=n), "b": r.integers(0, 9, n) / 3})
    pdf["z"] = 2 + pdf.a * (1 + 0.2 * pdf.x) - pdf.b + r.normal(size=n)
    return spark.createDataFrame(pdf).withColumn("z", F.when(F.col("fid") != 30, F.col("z")))


def dense_tests(p: local.Points, spec: local.Spec) -> dict:
    """The tests from whole matrices."""
    n, c = p.X.shape
    W = local.weights_of(spec, p, p.xy)
    C = np.stack([np.linalg.inv(p.X.T @ (w[:, None] * p.X)) @ p.X.T * w for w in W])
    S = (p.X[:, :, None] * C).sum(1)
    L = np.eye(n) - S
    R = L.T @ L
    V = np.eye(n) - p.X @ np.linalg.pinv(p.X) - R
    df1 = lambda Q: np.trace(Q) ** 2 / (Q * Q).sum()
    rss, rss0 = p.y @ R @ p.y, p.y @ (p.y - p.X @ np.linalg.pinv(p.X) @ p.y)
    out = {"F1": (rss / np.trace(R) / (rss0 / (n - c)), df1(R), n - c), "F2": ((rss0 - rss) / np.trace(V) / (rss0 / (n - c)), df1(V), n - c)}
    for k, name in enumerate(["Intercept", "a", "b"][:c]):
        B = C[:, k] - C[:, k].mean(0)
        Q = B.T @ B / n
        out[f"F3_{name}"] = (p.y @ Q @ p.y / np.trace(Q) / (rss / np.trace(R)), df1(Q), df1(R))
    return out | {"F4": (rss / rss0, np.trace(R), n - c)}


@pytest.mark.parametrize("spec", [local.Spec(4.0), local.Spec(60, "bisquare", True), local.Spec(300, "tricube", True), local.Spec(6.0, "exponential", metric="manhattan", theta=0.4)])
def test_tests_by_blocks_are_those_of_whole_matrices(places, spec):
    got = models.f_tests(places, "z", ["a", "b"], spec)
    expected = dense_tests(local.points(places, "z", ["a", "b"]), spec)
    assert list(got) == list(expected)
    for k, v in expected.items():
        assert np.allclose(got[k][:3], v, rtol=1e-7), k
        assert 0 <= got[k][3] <= 1


def test_tests_of_no_rows_and_singular_places(spark, places):
    assert models.f_tests(places.filter("false"), "z", ["a"], local.Spec(4.0)) == {}
    alone = models.f_tests(places, "z", ["a"], local.Spec(0.01, "boxcar"))
    assert np.isnan(alone["F1"][0])


@pytest.mark.parametrize("spec", [local.Spec(4.0), local.Spec(60, "bisquare", True), local.Spec(300, "tricube", True), local.Spec(6.0, "exponential", metric="manhattan", theta=0.4)])
def test_tests_of_shared_places_are_summed_by_places(places, spec, monkeypatch):
    """As many products as places need: no block of hat rows of the points themselves is made."""
    crowded = places.withColumn("x", F.col("x") % 5).withColumn("y", F.col("y") % 4).withColumn("x", F.when(F.col("fid") == 9, 99.0).otherwise(F.col("x")) if spec.adaptive else F.col("x"))
    expected = dense_tests(local.points(crowded, "z", ["a", "b"]), spec)
    monkeypatch.setattr(hats, "column_means", None)
    got = models.f_tests(crowded, "z", ["a", "b"], spec)
    assert list(got) == list(expected)
    for k, v in expected.items():
        assert np.allclose(got[k][:3], v, rtol=1e-7), k


@pytest.mark.parametrize("shared", [False, True])
def test_one_singular_place_makes_all_tests_nan(places, shared):
    at = lambda c, k: F.when(F.col("fid") == 0, 99.0).otherwise(F.col(c) % k).alias(c)
    got = models.f_tests(places.select("fid", at("x", 5 if shared else 99), at("y", 4 if shared else 99), "a", "z"), "z", ["a"], local.Spec(8.0, "boxcar"))
    assert all(np.isnan(v[0]) for v in got.values())


def test_hat_rows_span_several_blocks():
    assert hats.block_rows(170, 4) < 60 and hats.block_rows(10**5, 8) == hats.BLOCK and hats.block_rows(1, 8) == 1


@pytest.mark.parametrize("adaptive", [False, True])
def test_backfitted_columns_are_those_of_whole_matrices(spark, places, adaptive):
    p = local.points(places, "z", ["a", "b"])
    n, c = p.X.shape
    spec = lambda size: local.Spec(size * (20 if adaptive else 1), "gaussian", adaptive)
    steps = [(k, spec(2 + k + r)) for r in range(4) for k in range(c)]
    W = local.weights_of(spec(3), p, p.xy)
    C = np.stack([np.linalg.inv(p.X.T @ (w[:, None] * p.X)) @ p.X.T * w for w in W])
    S = [p.X[:, [k]] * C[:, k] for k in range(c)]
    for k, s in steps:
        A = local.weights_of(s, p, p.xy) * p.X[:, k]
        S[k] = p.X[:, [k]] * A / (A @ p.X[:, k])[:, None] @ (S[k] + np.eye(n) - sum(S))
    tr, ss, squares = hats.backfitted(spark, p, spec(3), steps)
    assert np.allclose([tr, ss], [np.trace(sum(S)), (sum(S) ** 2).sum()])
    assert np.allclose(squares, np.column_stack([((S[k] / p.X[:, [k]]) ** 2).sum(1) for k in range(c)]), equal_nan=True)


def test_multiscale_errors_beyond_the_former_bound(spark):
    """More points than fit one block: the same columns as for few."""
    r = np.random.default_rng(9)
    n = 2300
    pdf = pd.DataFrame({"fid": range(n), "x": r.uniform(0, 40, n), "y": r.uniform(0, 40, n), "a": r.normal(size=n)})
    pdf["z"] = 1 + pdf.a + r.normal(size=n)
    out, diag = models.multiscale_gwr(spark.createDataFrame(pdf), "z", {"Intercept": local.Spec(8.0), "a": local.Spec(12.0)}, hat=True, most=2)
    assert out.filter("Intercept_SE > 0 AND a_SE > 0 AND a_TV IS NOT NULL").count() == n and 2 < diag["tr_s"] < 200


def test_backfitting_goes_by_places_and_by_factors_of_smooth_kernels(spark, monkeypatch):
    """More points than MOST_POINTS at fewer places, hundreds of rounds: the same as back-fitting whole matrices."""
    r = np.random.default_rng(12)
    xy = r.uniform(0, 10, (60, 2))
    at = np.r_[0:60, r.integers(0, 40, 60)]
    pdf = pd.DataFrame({"fid": range(120), "x": xy[at, 0], "y": xy[at, 1], "a": 3 + r.normal(size=120)})
    pdf["z"] = 1 + pdf.a + r.normal(size=120)
    X, y = np.column_stack([np.ones(120), pdf.a]), pdf.z.to_numpy()
    d = np.hypot(*(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy() for c in "xy"))
    W = [np.exp(-d * d / 2 / b**2) for b in (60.0, 40.0)]
    S = np.stack([np.linalg.solve((X.T * w) @ X, X.T * w) for w in W[0]]).transpose(1, 0, 2)
    for _ in range(200):
        for k in (0, 1):
            rest = np.eye(120) - X[:, [1 - k]] * S[1 - k]
            S[k] = (W[k] * X[:, k]) @ rest / (W[k] @ X[:, k] ** 2)[:, None]
    whole = np.einsum("ik,kij->ij", X, S)
    tr, ss = np.trace(whole), (whole**2).sum()
    monkeypatch.setattr(local, "MOST_POINTS", 100)
    specs = {"Intercept": local.Spec(60.0), "a": local.Spec(40.0)}
    for factors in (hats.MOST_FACTORS, 0):
        monkeypatch.setattr(hats, "MOST_FACTORS", factors)
        assert (hats.factor(specs["a"], local.Points(np.arange(60), xy, np.zeros((60, 0)), np.zeros(60))) is not None) == (factors > 0)
        out, diag = models.multiscale_gwr(spark.createDataFrame(pdf), "z", specs, tol=0.0, most=200, hat=True)
        got = out.toPandas().sort_values("fid")
        assert diag["rounds"] == 200 and np.allclose([diag["tr_s"], diag["tr_sts"]], [tr, ss], rtol=1e-7)
        error = np.sqrt(((y - whole @ y) ** 2).sum() / (120 - 2 * tr + ss))
        for k, name in enumerate(specs):
            assert np.allclose(got[name], S[k] @ y, rtol=1e-7)
            assert np.allclose(got[f"{name}_SE"], error * np.sqrt((S[k] ** 2).sum(1)), rtol=1e-7)
