"""One semantics for the dense plans and those for any number of rows; local models on nulls, repeats and empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lokalis.functions import kernels
from lokalis.operators import dense, local, models, pairs, tiles
from lokalis.sources.store import folder


@pytest.fixture(scope="module")
def scattered(spark):
    """Points with ties in place and value, nulls, and one far from all others."""
    r = np.random.default_rng(5)
    n = 90
    pdf = pd.DataFrame({"fid": range(n), "x": r.integers(0, 12, n).astype(float), "y": r.integers(0, 9, n).astype(float), "a": r.integers(0, 20, n) / 4, "b": r.normal(size=n), "t": (np.arange(n) % 7).astype(float)})
    pdf["z"] = 2 + pdf.a - 0.1 * pdf.x * pdf.b + r.normal(size=n) * 0.2
    pdf["count"] = r.poisson(np.exp(0.3 + 0.1 * pdf.a)).astype(float)
    pdf["flag"] = (pdf.b + r.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame(pdf)
    for column, at in (("a", 3), ("z", 5), ("x", 7), ("b", 11), ("count", 3), ("flag", 3)):
        df = df.withColumn(column, F.when(F.col("fid") != at, F.col(column)))
    return df.cache()


def places(spark):
    return spark.createDataFrame([(1000, 3.0, 3.0), (1001, 500.0, 500.0), (1002, 3.5, 2.5), (1003, None, 1.0)], "fid long, x double, y double")


def same(a, b, key=("fid",)):
    a, b = (x.sort_values(list(key)).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-7, atol=1e-8, equal_nan=True), c


def plan_for_many(f, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(dense, "small", lambda data: False)
        m.setattr(models, "MOST_POINTS", 0)
        m.setattr(tiles, "TILE", 45)
        m.setattr(tiles, "PARTS", 16)
        for g in (tiles.tiled, tiles.means, tiles.quantiles, tiles.correlation, tiles.summed, tiles.local_fits, tiles.basic, tiles.robust, tiles.generalized, tiles.second_pass, tiles.reached, tiles.kth_distance, tiles.score):
            names = g.__code__.co_varnames[: g.__code__.co_argcount]
            d = list(g.__defaults__ or ())
            if "tile" in names:
                d[names.index("tile") - len(names) + len(d)] = 45
                m.setattr(g, "__defaults__", tuple(d))
        return f()


SPECS = [local.Spec(2.5), local.Spec(2.5, "boxcar"), local.Spec(9, "bisquare", True), local.Spec(200, "exponential", True), local.Spec(3.0, "tricube", metric="manhattan", theta=0.4), local.Spec(12, "gaussian", True, metric=3.0, theta=0.3), local.Spec(300.0, "gaussian", metric="geographic")]


@pytest.mark.parametrize("spec", SPECS, ids=str)
def test_summaries_are_alike_in_all_plans_and_for_all_subsets(spark, scattered, monkeypatch, spec):
    df = scattered
    foci = df.select("fid", "x", "y").union(places(spark))
    for q in (lambda f: dense.means(f, df, ["a", "z"], spec), lambda f: dense.quantiles(f, df, "a", spec), lambda f: dense.spearman(f, df, "a", "z", spec), lambda f: dense.correlations(f, df, ["a"], ["z"], spec)):
        got = q(foci).toPandas()
        assert len(got) == 90 - 1 + 3  # a row for each focus with coordinates
        same(got, plan_for_many(lambda: q(foci).toPandas(), monkeypatch))
        few = foci.filter("fid in (10, 1001, 1002)")
        same(got[got.fid.isin([10, 1001, 1002])], q(few).toPandas())
        if spec.kernel in kernels.COMPACT and not spec.adaptive:
            assert got[got.fid == 1001].drop(columns="fid").isna().all(axis=None)


@pytest.mark.parametrize("spec", [local.Spec(4.0), local.Spec(20, "bisquare", True), local.Spec(30, "tricube", True, metric="manhattan")], ids=str)
@pytest.mark.parametrize("t", [None, "t"])
def test_regressions_are_alike_in_both_plans(scattered, monkeypatch, spec, t):
    if t:
        spec = local.Spec(spec.size, spec.kernel, spec.adaptive, spec.metric, time_scale=0.5, future="exclude")
    got, diag = models.gwr(scattered, "z", ["a", "b"], spec, t)
    rows, more = plan_for_many(lambda: (lambda r: (r[0].toPandas(), r[1]))(models.gwr(scattered, "z", ["a", "b"], spec, t)), monkeypatch)
    assert len(rows) == 86
    same(got.toPandas(), rows)
    assert diag.keys() == more.keys() and all(math.isclose(diag[k], more[k], rel_tol=1e-7) for k in diag)


def test_scores_robust_and_generalized_fits_are_alike_in_both_plans(scattered, monkeypatch):
    spec = local.Spec(5.0)
    cases = [lambda: models.robust_gwr(scattered, "z", ["a"], spec), lambda: models.robust_gwr(scattered, "z", ["a"], spec, "iterative"), lambda: models.generalized_gwr(scattered, "count", ["b"], spec), lambda: models.generalized_gwr(scattered, "flag", ["b"], spec, "binomial")]
    for f in cases:
        run = lambda: (lambda r: (r[0].toPandas(), r[1]))(f())  # noqa: B023, E731
        (a, da), (b, db) = run(), plan_for_many(run, monkeypatch)
        same(a, b)
        assert all(math.isclose(da[k], db[k], rel_tol=1e-7) for k in da if k in db)
    p, rows = local.points(scattered, "z", ["a"]), tiles.state(scattered, "z", ["a"])
    for criterion in ("CV", "AICc"):
        for s in (spec, local.Spec(25, "bisquare", True)):
            assert math.isclose(models.score(scattered, p, s, criterion), tiles.score(rows, ["Intercept", "a"], s, criterion, 25), rel_tol=1e-7)


def test_predictions_are_alike_in_both_plans(spark, scattered, monkeypatch):
    foci = places(spark).withColumn("a", F.lit(1.5))
    for spec in (local.Spec(3.0, "bisquare"), local.Spec(3.0), local.Spec(25, "bisquare", True)):
        got = models.gwr_predict(scattered, foci, "z", ["a"], spec).toPandas()
        assert sorted(got.fid) == [1000, 1001, 1002]
        same(got, plan_for_many(lambda: models.gwr_predict(scattered, foci, "z", ["a"], spec).toPandas(), monkeypatch))


def test_a_broken_off_fit_goes_on(spark, scattered, monkeypatch):
    rows, at = tiles.state(scattered, "count", ["b"]), folder(spark)
    whole, diag = tiles.generalized(rows, ["Intercept", "b"], local.Spec(5.0), "poisson")
    tiles.generalized(rows, ["Intercept", "b"], local.Spec(5.0), "poisson", most=2, at=at)  # two rounds, as if stopped there
    with monkeypatch.context() as m:
        m.setattr(tiles, "log_counts", tiles.log_counts)
        rest, more = tiles.generalized(rows, ["Intercept", "b"], local.Spec(5.0), "poisson", at=at)
    same(whole.toPandas(), rest.toPandas())
    assert diag["rounds"] == more["rounds"] and math.isclose(diag["aicc"], more["aicc"], rel_tol=1e-9)


MODELS = {
    "gwr": lambda df: models.gwr(df, "z", ["a"], local.Spec(5.0))[0],
    "gtwr": lambda df: models.gwr(df, "z", ["a"], local.Spec(5.0, time_scale=0.1), "t")[0],
    "no intercept": lambda df: models.gwr(df, "z", ["a"], local.Spec(5.0), intercept=False)[0],
    "robust": lambda df: models.robust_gwr(df, "z", ["a"], local.Spec(5.0), "iterative")[0],
    "ridge": lambda df: models.ridge_gwr(df, "z", ["a"], local.Spec(5.0)),
    "poisson": lambda df: models.generalized_gwr(df, "count", ["a"], local.Spec(5.0))[0],
    "density": lambda df: models.gtdr(df, "z", ["a"], [local.Spec(5.0)]),
    "multiscale": lambda df: models.multiscale_gwr(df, "z", {"Intercept": local.Spec(5.0), "a": local.Spec(5.0)})[0],
    "components": lambda df: models.gwpca(df, ["a", "z"], 2, local.Spec(5.0)),
    "scalable": lambda df: models.scalable_gwr(df, "z", ["a"], k=10)[0],
}


@pytest.mark.parametrize("name", MODELS)
def test_rows_with_nulls_are_left_out(scattered, name):
    df = scattered.withColumn("count", F.abs(F.col("count")))
    got = MODELS[name](df).toPandas()
    wanted = df.dropna(subset=["x", "y", "a", "z", "count"] if name == "poisson" else ["x", "y", "a", "z"])
    clean = MODELS[name](wanted).toPandas()
    assert len(got) == (87 if name != "poisson" else 88) and set(clean.fid) <= set(got.fid)
    if name != "poisson":
        columns = ["fid", *(c for c in ("Intercept", "a", "Comp.1_PV") if c in got)]
        same(got[columns], clean[columns])


@pytest.mark.parametrize("name", MODELS)
def test_repeated_ids_are_an_error_and_empty_tables_give_no_rows(scattered, name):
    with pytest.raises(ValueError, match="unique"):
        MODELS[name](scattered.withColumn("fid", F.expr("fid div 2"))).count()
    assert MODELS[name](scattered.limit(0)).count() == 0


def test_scores_and_diagnostics_of_tables_with_nulls(scattered):
    df = scattered
    (_, cv, aicc), = models.bandwidth_scores(df, "z", ["a"], local.Spec(0), [5.0])
    p = local.points(df, "z", ["a"])
    assert math.isclose(cv, models.score(df, p, local.Spec(5.0))) and math.isclose(aicc, models.score(df, p, local.Spec(5.0), "AICc"))
    assert models.ridge_diagnostics(df, "z", ["a"], local.Spec(5.0))["tr_s"] > 2
    assert models.bandwidth_scores(df.limit(0), "z", ["a"], local.Spec(0), [5.0]) == [(5.0, math.inf, math.inf)] and models.ridge_diagnostics(df.limit(0), "z", ["a"], local.Spec(5.0)) == {}


def test_global_models_by_sums_equal_those_of_arrays(scattered):
    df, p = scattered, local.points(scattered, "z", ["a", "b"])
    a, b = models.ols(p), models.ols_of(df.dropna(subset=["x"]), "z", ["a", "b"])
    assert all(np.allclose(a[k], b[k]) for k in a)
    for family, y in (("poisson", "count"), ("binomial", "flag")):
        a, b = models.glm(local.points(df, y, ["b"]), family), models.glm_of(df.dropna(subset=["x"]), y, ["b"], family)
        assert all(np.allclose(a[k], b[k], rtol=1e-6) for k in a)
    assert models.ols_of(df.limit(0), "z", ["a"]) == {} and models.glm_of(df.limit(0), "count", ["a"], "poisson") == {}


def test_no_plan_for_many_rows_is_a_cross_join(scattered, monkeypatch):
    text = plan_for_many(lambda: dense.means(scattered, scattered, ["z"], local.Spec(5.0))._jdf.queryExecution().toString(), monkeypatch)
    assert "Cartesian" not in text and "NestedLoop" not in text and "CoGroup" in text.replace("FlatMapCoGroups", "CoGroup")
    assert pairs.BROADCAST_POINTS > 0


@pytest.mark.parametrize("spec", [local.Spec(1.2, "bisquare"), local.Spec(2, "bisquare", True)], ids=str)
def test_singular_places_have_no_coefficients_and_stop_nothing(scattered, spec):
    """Foci with too few points for their coefficients."""
    got = models.gwr(scattered, "z", ["a", "b"], spec)[0].toPandas()
    assert len(got) == 86 and got["Intercept"].isna().any()
    assert models.ridge_gwr(scattered, "z", ["a"], spec).count() == 87 and models.gtdr(scattered, "z", ["a"], [local.Spec(1e-9, "boxcar")]).count() == 87
