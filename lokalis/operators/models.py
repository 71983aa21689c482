"""Local regression models and local principal components on the dense engine of ``local``.

Results are DataFrames by focus; diagnostics are dictionaries of a few numbers. Singular local systems
give NaN coefficients with ``ok`` false, and an infinite score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.sources.store import dropped, written

from . import dense, hats, neighbours, pairs, sites, tiles
from .local import BLOCK_PAIRS, FIT, MOST_POINTS, Points, Sites, Spec, distances, fit_block, fit_rows, free, golden, local_fit, over_foci, own_foci, place_sums, points, sites_of, solve, weigh, weights_of, with_size


#: The fewest points of adaptive bandwidths that these models' searches try by default (20 for others).
LEAST_POINTS = {"multiscale": 10, "components": 2}
#: Points of a multiscale model, at most MOST_POINTS places: they are held as columns of numbers, all pairs are those of places.
MULTISCALE_POINTS = 1_000_000
#: Points whose scores on local components are asked for: they are broadcast.
SCORED_POINTS = 1_000_000


def names_of(xs: list[str], intercept: bool = True) -> list[str]:
    return (["Intercept"] if intercept else []) + list(xs)


def spread_out(df: DataFrame, column: str, names: list[str]) -> list:
    return [F.col(column)[k].alias(n) for k, n in enumerate(names)]


def nothing(df: DataFrame, names: list[str]) -> DataFrame:
    """No rows of a model's columns."""
    return df.sparkSession.createDataFrame([], "fid bigint, " + ", ".join(f"`{n}` double" for n in names))


def ols(p: Points) -> dict:
    """Global least squares: coefficients, standard errors, t values, R2, AIC and AICc."""
    n, k = p.X.shape
    inv = np.linalg.inv(p.X.T @ p.X)
    beta = inv @ p.X.T @ p.y
    rss, tss = float(((p.y - p.X @ beta) ** 2).sum()), float(((p.y - p.y.mean()) ** 2).sum())
    se = np.sqrt(np.diag(inv) * rss / (n - k))
    r2 = 1 - rss / tss
    aic = n * math.log(rss / n) + n * math.log(2 * math.pi) + n + 2 * (k + 1)
    return {"beta": beta, "se": se, "t": beta / se, "rss": rss, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "aic": aic, "aicc": aic + 2 * (k + 1) * (k + 2) / (n - k - 2)}


def gram(df: DataFrame, columns: list, weight=None) -> np.ndarray:
    """Sums of products of all pairs of columns, by weight: one row reaches the driver."""
    w = F.lit(1.0) if weight is None else weight
    k = len(columns)
    which = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(w * columns[i] * columns[j]).alias(f"g{i}_{j}") for i, j in which)).first()
    G = np.zeros((k, k))
    for i, j in which:
        G[i, j] = G[j, i] = row[f"g{i}_{j}"] or 0.0
    return G


def numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").try_cast("double").alias(f"v{k}") for k, c in enumerate(names))).dropna()


def ols_of(df: DataFrame, y: str, xs: list[str]) -> dict:
    """``ols`` of a table of any size: sums about the means are aggregated by Spark, two rows reach the driver."""
    rows = numbers(df, [*xs, y])
    k = len(xs) + 1
    m = rows.agg(F.count("*").alias("n"), *(F.avg(f"v{i}").alias(f"m{i}") for i in range(k))).first()
    n, mean = m["n"], np.array([m[f"m{i}"] for i in range(k)], float)
    if not n:
        return {}
    G = gram(rows, [F.col(f"v{i}") - F.lit(float(mean[i])) for i in range(k)])
    inv = np.linalg.inv(G[:-1, :-1])
    slope = inv @ G[:-1, -1]
    beta = np.concatenate([[mean[-1] - slope @ mean[:-1]], slope])
    tss = G[-1, -1]
    rss = float(tss - slope @ G[:-1, -1])
    var = np.concatenate([[1 / n + mean[:-1] @ inv @ mean[:-1]], np.diag(inv)])
    se = np.sqrt(var * rss / (n - k))
    r2 = 1 - rss / tss
    aic = n * math.log(rss / n) + n * math.log(2 * math.pi) + n + 2 * (k + 1)
    return {"beta": beta, "se": se, "t": beta / se, "rss": rss, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "aic": aic, "aicc": aic + 2 * (k + 1) * (k + 2) / (n - k - 2)}


def glm_of(df: DataFrame, y: str, xs: list[str], family: str, most: int = 25, eps: float = 1e-8) -> dict:
    """``glm`` of a table of any size: each round aggregates the weighted sums by Spark."""
    rows = tiles.log_counts(numbers(df, [*xs, y]), f"v{len(xs)}", family)
    yy, X = F.col(f"v{len(xs)}"), [F.lit(1.0), *(F.col(f"v{i}") for i in range(len(xs)))]
    k, nu, last = len(X), None, math.inf
    n, mean = rows.agg(F.count("*"), F.avg(yy)).first()
    if not n:
        return {}
    for _ in range(most):
        mu, z, v = tiles.family_columns(family, yy, nu)
        G = gram(rows, [*X, z], v)
        beta = np.linalg.solve(G[:k, :k], G[:k, k])
        nu = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], X[1:])), F.lit(float(beta[0])))
        mu, _, v = tiles.family_columns(family, yy, nu)
        ll = rows.agg(F.sum(tiles.likelihood_column(family, yy, mu))).first()[0]
        if abs(ll - last) / (abs(ll) + 0.1) < eps:
            break
        last = ll
    se = np.sqrt(np.diag(np.linalg.inv(gram(rows, X, v))))
    dev, null = rows.agg(F.sum(tiles.deviance_column(family, yy, mu)), F.sum(tiles.deviance_column(family, yy, F.lit(mean)))).first()
    return {"beta": beta, "se": se, "log_likelihood": ll, "deviance": dev, "null_deviance": null, "pseudo_r2": 1 - dev / null, "aic": dev + 2 * k, "aicc": dev + 2 * k + 2 * k * (k + 1) / (n - k - 1)}


def aicc_of(n: int, rss: float, trace: float) -> float:
    return n * math.log(rss / n) + n * math.log(2 * math.pi) + n * (n + trace) / (n - 2 - trace) if n - 2 - trace > 0 and rss > 0 else math.inf


def diagnostics(p: Points, rss: float, s: float, ss: float) -> dict:
    n, tss = len(p.y), float(((p.y - p.y.mean()) ** 2).sum())
    enp = 2 * s - ss
    edf = n - enp
    r2 = 1 - rss / tss
    return {"rss": rss, "aic": n * math.log(rss / n) + n * math.log(2 * math.pi) + n + s, "aicc": aicc_of(n, rss, s), "enp": enp, "edf": edf, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (edf - 1), "tr_s": s, "tr_sts": ss}


class SecondPass:
    """What needs all fitted values: the local R2 of a task's foci, and at the task's end its foci's share of every data point's q = sum_i (delta_ij - s_ij)^2."""

    def __init__(self):
        self.q: np.ndarray | None = None
        self.fid: np.ndarray | None = None

    def block(self, pdf: pd.DataFrame, held) -> pd.DataFrame:
        spec, p, extra, yhat = held
        t = pdf.t.to_numpy(float) if "t" in pdf else None
        W = weights_of(spec, p, pdf[["x", "y"]].to_numpy(float), t)
        tss, rss = W @ (p.y - p.y.mean()) ** 2, W @ (p.y - yhat) ** 2
        W = W if extra is None else W * extra[None, :]
        at = np.searchsorted(p.fid, pdf.fid.to_numpy(np.int64))
        half, _ = solve(np.einsum("mn,np,nq->mpq", W, p.X, p.X, optimize=True), p.X[at])
        S = W * (half @ p.X.T)
        S[np.arange(len(at)), at] -= 1
        self.q, self.fid = (0 if self.q is None else self.q) + np.nansum(S * S, 0), p.fid
        with np.errstate(all="ignore"):
            return pd.DataFrame({"fid": pdf.fid.to_numpy(np.int64), "localR2": (tss - rss) / tss, "q": 0.0})

    def ended(self) -> Iterator[pd.DataFrame]:
        if self.q is not None:
            yield pd.DataFrame({"fid": self.fid, "localR2": math.nan, "q": self.q})


def fitted(df: DataFrame, p: Points, spec: Spec, extra: np.ndarray | None = None, t: str | None = None, noise: np.ndarray | None = None) -> pd.DataFrame:
    """FIT rows of all data points on the driver, in the points' order (bounded by MOST_POINTS)."""
    rows = local_fit(own_foci(df, p), p, spec, extra, t, noise)
    out = gathered(rows)
    free(rows)
    return out


def gathered(rows: DataFrame) -> pd.DataFrame:
    """Fits in the order of their ids; what a singular system leaves open is NaN."""
    out = rows.toPandas().sort_values("fid", kind="stable").reset_index(drop=True)
    for c in ("beta", "raw"):
        out[c] = [np.array(v, float) for v in out[c]]
    return out


def score(df: DataFrame, p: Points, spec: Spec, criterion: str = "CV", t: str | None = None) -> float:
    """CV or AICc of a bandwidth; one job, one row to the driver."""
    rows = local_fit(own_foci(df, p), p, spec, t=t)
    if criterion == "CV":
        v = rows.agg(F.sum(F.col("cv") * F.col("cv")).alias("v"), F.min("ok").alias("ok")).first()
        free(rows)
        return float(v["v"]) if v["v"] is not None and math.isfinite(v["v"]) else math.inf
    base = df.sparkSession.createDataFrame(pd.DataFrame({"fid": p.fid, "yy": p.y, "xx": [list(map(float, r)) for r in p.X]}))
    hat = F.aggregate(F.zip_with("beta", "xx", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    v = rows.join(base, "fid").agg(F.sum((F.col("yy") - hat) ** 2).alias("rss"), F.sum("s_ii").alias("s")).first()
    free(rows)
    return aicc_of(len(p.y), v["rss"], v["s"]) if v["rss"] and math.isfinite(v["rss"]) else math.inf


def bandwidth_limits(p: Points, spec: Spec) -> tuple[float, float]:
    """The search's default limits: 20 to n points, or 0 to the largest distance between the corners of the points' box."""
    if spec.adaptive:
        return 20.0, float(len(p.fid))
    return 0.0, float(np.hypot(*(p.xy.max(0) - p.xy.min(0)))) if spec.metric != "geographic" else 20037.5


def select_bandwidth(df: DataFrame, p: Points, spec: Spec, criterion: str = "CV", t: str | None = None, by: Callable[[Spec], float] | None = None, limits: tuple[float, float] | None = None) -> tuple[float, list[tuple[float, float]]]:
    """Golden-section search between ``limits``; ``by`` scores a model of another kind."""
    low, high = limits or bandwidth_limits(p, spec)
    return golden(lambda b: by(with_size(spec, b)) if by else score(df, p, with_size(spec, b), criterion, t), low, high, spec.adaptive)


def bandwidth_scores(df: DataFrame, y: str, xs: list[str], spec: Spec, sizes: list[float], t: str | None = None, intercept: bool = True) -> list[tuple[float, float, float]]:
    """(bandwidth, CV, AICc) of given bandwidths: the curve that the search walks on."""
    p = points(df, y, xs, t, intercept)
    out = [] if len(p.fid) else [(float(b), math.inf, math.inf) for b in sizes]
    for b in sizes if len(p.fid) else []:
        f = fitted(df, p, with_size(spec, b), t=t)
        rss = float(((p.y - (np.stack(f.beta) * p.X).sum(1)) ** 2).sum())
        out.append((float(b), float((f.cv**2).sum(skipna=False)), aicc_of(len(p.y), rss, float(f.s_ii.sum()))))
    return out


def forward_selection(df: DataFrame, y: str, xs: list[str], threshold: float = 3.0) -> tuple[list[str], list[tuple[list[str], float]]]:
    """Add the variable with the lowest global AICc at each level; all models come from one Gram matrix, aggregated once. Returns the pick and all models."""
    cols = [F.lit(1.0), *(F.col(v).cast("double") for v in (*xs, y))]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.select(*xs, y).dropna().agg(*(F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    G = np.zeros((k, k))
    for i, j in pairs:
        G[i, j] = G[j, i] = row[f"g{i}_{j}"]
    n = G[0, 0]

    def aicc(pick: list[int]) -> float:
        own = [0, *(i + 1 for i in pick)]
        A, b = G[np.ix_(own, own)], G[own, k - 1]
        try:
            rss = float(G[k - 1, k - 1] - b @ np.linalg.solve(A, b))
        except np.linalg.LinAlgError:
            return math.inf
        return aicc_of(int(n), rss, float(len(own)))

    return forward(xs, aicc, threshold)


def forward(xs: list[str], aicc: Callable[[list[int]], float], threshold: float) -> tuple[list[str], list[tuple[list[str], float]]]:
    """Add the variable with the lowest score at each level; the pick ends with the last level that lowers the score by the threshold."""
    left, taken, models = list(range(len(xs))), [], []
    best_by_level = []
    while left:
        level = [(aicc([*taken, i]), i) for i in left]
        models += [([xs[j] for j in [*taken, i]], a) for a, i in sorted(level, reverse=True)]
        a, i = min(level)
        taken.append(i)
        left.remove(i)
        best_by_level.append(a)
    pick = len(xs)
    for i in range(len(xs) - 1, 0, -1):
        if best_by_level[i - 1] - best_by_level[i] >= threshold:
            pick = i + 1
            break
    return [xs[j] for j in taken[:pick]], models


def local_selection(df: DataFrame, y: str, xs: list[str], spec: Spec, threshold: float = 3.0) -> tuple[list[str], list[tuple[list[str], float]]]:
    """``forward_selection`` by the AICc of the local models of one bandwidth."""
    whole = points(df, y, xs)

    def aicc(pick: list[int]) -> float:
        p = Points(whole.fid, whole.xy, whole.X[:, [0, *(i + 1 for i in pick)]], whole.y)
        return score(df, p, spec, "AICc")

    return forward(xs, aicc, threshold)


def gwr(df: DataFrame, y: str, xs: list[str], spec: Spec, t: str | None = None, extra: np.ndarray | None = None, select_bw: str | None = None, intercept: bool = True) -> tuple[DataFrame, dict]:
    """Basic (with ``t`` space-time) regression at the data points: coefficients, y, yhat, residual, studentised residual, SE, t values and local R2; diagnostics.

    Rows with a null among place, time and variables are left out; repeated ids are an error; without rows there are
    no results and no diagnostics. Beyond MOST_POINTS rows everything is summed over tiles.
    """
    names = names_of(xs, intercept)
    if large(df):
        rows = tiles.state(df, y, xs, t, intercept)
        if select_bw:
            spec = with_size(spec, select_by_tiles(rows, names, spec, select_bw)[0])
        return tiles.basic(rows, names, spec)
    p = points(df, y, xs, t, intercept)
    if not len(p.fid):
        return nothing(df, result_names(names)), {}
    if select_bw:
        spec = with_size(spec, select_bandwidth(df, p, spec, select_bw, t)[0])
    f = fitted(df, p, spec, extra, t)
    beta, raw = np.stack(f.beta), np.stack(f.raw)
    yhat = (beta * p.X).sum(1)
    res = p.y - yhat
    s, ss, rss = f.s_ii.sum(), f.ss.sum(), float((res**2).sum())
    diag = diagnostics(p, rss, s, ss) | {"bandwidth": spec.size}
    sigma2 = rss / (len(p.y) - 2 * s + ss)
    work = SecondPass()
    again = over_foci(own_foci(df, p), (spec, p, extra, yhat), work.block, "fid bigint, localR2 double, q double", len(p.fid), work.ended)
    more = again.groupBy("fid").agg(F.max(F.nanvl("localR2", F.lit(None).cast("double"))).alias("localR2"), F.sum("q").alias("q")).toPandas().sort_values("fid", kind="stable")
    free(again)
    se = np.sqrt(sigma2 * raw)
    with np.errstate(all="ignore"):
        values = [*beta.T, p.y, yhat, res, res / np.sqrt(sigma2 * more.q.to_numpy(float)), *se.T, *(beta / se).T, more.localR2.to_numpy(float)]
    return df.sparkSession.createDataFrame(pd.DataFrame({"fid": p.fid, **dict(zip(result_names(names), values))})), diag


def result_names(names: list[str]) -> list[str]:
    return [*names, "y", "yhat", "residual", "Stud_residual", *(f"{n}_SE" for n in names), *(f"{n}_TV" for n in names), "localR2"]


def large(df: DataFrame) -> bool:
    """More rows than what the dense engine may hold in each task."""
    return df.count() > MOST_POINTS


def select_by_tiles(rows: DataFrame, names: list[str], spec: Spec, criterion: str = "CV", limits: tuple[float, float] | None = None) -> tuple[float, list[tuple[float, float]]]:
    """Golden-section search of a bandwidth over tables of any size."""
    if limits is None:
        box = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y"))).first()
        limits = (20.0, float(box["n"])) if spec.adaptive else (0.0, math.hypot(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) if spec.metric != "geographic" else 20037.5)
    return golden(lambda b: tiles.score(rows, names, with_size(spec, b), criterion), *limits, spec.adaptive)


def coefficients_by_pairs(df: DataFrame, focus: DataFrame, y: str, xs: list[str], bw: pairs.Bandwidth, intercept: bool = True) -> DataFrame:
    """``fid``, the coefficients and ``ok`` without a bound on the points: moments are sums over weighted pairs, partly summed before they are shuffled, and each focus's small system is solved by itself."""
    cols = ["fid", "x", "y"]
    own = [F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate([*xs, y])]
    data = df.select(F.col("fid").cast("long").alias("fid"), *(F.col(c).cast("double").alias(c) for c in cols[1:]), *own).dropna()
    w = pairs.weighted(focus.select(F.col("fid").cast("long").alias("fid"), *(F.col(c).cast("double").alias(c) for c in cols[1:])).dropna(), data, bw)
    terms = ([F.lit(1.0)] if intercept else []) + [F.col(f"d_v{k}") for k in range(len(xs))]
    k, response = len(terms), F.col(f"d_v{len(xs)}")
    sums = [F.sum(F.col("w") * terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("w") * t * response).alias(f"r{i}") for i, t in enumerate(terms)]
    names = names_of(xs, intercept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            A = np.stack([np.stack([pdf[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)], 1) for i in range(k)], 1)
            beta, ok = solve(A, np.stack([pdf[f"r{i}"] for i in range(k)], 1))
            yield pd.DataFrame({"fid": pdf.fid, **{n: beta[:, i] for i, n in enumerate(names)}, "ok": ok})

    return w.groupBy("fid").agg(*sums).mapInPandas(run, "fid bigint, " + ", ".join(f"`{n}` double" for n in names) + ", ok boolean")


def gwr_predict(df: DataFrame, focus: DataFrame, y: str, xs: list[str], spec: Spec) -> DataFrame:
    """Coefficients at other points, and yhat where these hold all variables. Foci without weight have null coefficients and ``ok`` false. Beyond MOST_POINTS rows the moments are sums over tiles."""
    if large(df):
        rows = tiles.state(df, y, xs)
        at = tiles.reached(dense.places(focus), rows, spec)
        rows = tiles.local_fits(at, rows, spec, len(xs) + 1).select("fid", *spread_out(df, "beta", names_of(xs)), "ok")
    else:
        rows = local_fit(focus, points(df, y, xs), spec).select("fid", *spread_out(df, "beta", names_of(xs)), "ok")
    if not set(xs) <= set(focus.columns):
        return rows
    own = focus.select(F.col("fid").cast("long").alias("fid"), *(F.col(v).cast("double").alias(f"own_{v}") for v in xs))
    hat = F.col("Intercept")
    for v in xs:
        hat = hat + F.col(v) * F.col(f"own_{v}")
    return rows.join(own, "fid").withColumn("yhat", hat).drop(*(f"own_{v}" for v in xs))


def robust_gwr(df: DataFrame, y: str, xs: list[str], spec: Spec, method: str = "filter", most: int = 20, tol: float = 1e-5) -> tuple[DataFrame, dict]:
    """Robust regression: drop points whose studentised residual exceeds 3 and refit, or iterate weights that fall from 1 at 2 to 0 at 3 residual deviations."""
    if large(df):
        return tiles.robust(tiles.state(df, y, xs), names_of(xs), spec, method, most, tol)
    p = points(df, y, xs)
    if not len(p.fid):
        return gwr(df, y, xs, spec)
    if method == "filter":
        first, _ = gwr(df, y, xs, spec)
        r = first.select("fid", "Stud_residual").toPandas().sort_values("fid").Stud_residual.to_numpy()
        return gwr(df, y, xs, spec, extra=(np.abs(r) <= 3).astype(float))
    extra, mse = np.ones(len(p.y)), None
    for _ in range(most + 1):
        used = extra
        f = fitted(df, p, spec, used)
        res = p.y - (np.stack(f.beta) * p.X).sum(1)
        last, mse = mse, float((res**2).mean())
        r = np.abs(res) / math.sqrt(mse) if mse > 0 else np.zeros(len(res))
        extra = np.where(r <= 2, 1.0, np.where(r < 3, (1 - (r - 2) ** 2) ** 2, 0.0))
        if mse == 0 or (last is not None and abs(last - mse) / mse <= tol):
            break
    return gwr(df, y, xs, spec, extra=used)


RIDGE = "fid bigint, beta array<double>, lambda double, condition double, raw array<double>, s_ii double, ss double"


def at_sites(p: Points, site: np.ndarray, s: Sites) -> tuple[np.ndarray, np.ndarray]:
    """Of all points at these places: the place's number among them, and the point's."""
    rows = s.rows[site]
    return np.repeat(np.arange(len(site)), rows), s.members[np.repeat(s.first[site], rows) + np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)]


def over_sites(df: DataFrame, p: Points, spec: Spec, more: tuple, f: Callable[[pd.DataFrame, object], pd.DataFrame], schema: str, width: int, summed: Points | None = None) -> DataFrame:
    """``f`` of blocks of places against all places, for the points there: held are the spec, the places, what is at them (sums of ``summed``, if given), the points and ``more``."""
    places, s = sites_of(summed or p, None, False, None)
    once = df.sparkSession.range(len(places.fid)).withColumnRenamed("id", "i")
    return over_foci(once, (spec, places, s, p, *more), f, schema, max(len(places.fid), int(s.rows.max(initial=1)) * width**2))


def column_condition(N: np.ndarray, exact: Callable[[int], np.ndarray]) -> np.ndarray:
    """Largest and smallest singular value of columns of unit length, by their products N; ``exact`` gives the columns where products have lost the smallest."""
    norm = np.sqrt(np.maximum(np.einsum("mpp->mp", N), 1e-300))
    val = np.linalg.eigvalsh(N / norm[:, :, None] / norm[:, None, :])
    sv = np.sqrt(np.maximum(val[:, [-1, 0]], 0))
    for k in np.flatnonzero(~(val[:, 0] > 1e-9 * val[:, -1])):
        wx = exact(k)
        own = np.linalg.svd(wx / np.maximum(np.linalg.norm(wx, axis=0), 1e-300), compute_uv=False)
        sv[k] = own[0], own[-1]
    return sv


def ridge_sites(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """Ridge solutions by scaled, weighted data for all points at each place; ``leave``: each point is left out of its own fit."""
    spec, places, s, p, lam, adjust, limit, leave, conditions = held
    c, site = p.X.shape[1], pdf.fid.to_numpy(np.int64)
    W = weights_of(spec, places, pdf[["x", "y"]].to_numpy(float), rows=s.rows)
    sd = p.X.std(0, ddof=1)
    sd[0] = 1
    scale = np.concatenate([np.outer(sd, sd).ravel(), sd])
    sums, squares = W @ (s.sums / scale), ((W * W) @ (s.squares / scale[: c * c])).reshape(-1, c, c)
    A, b = sums[:, : c * c].reshape(-1, c, c), sums[:, c * c :]
    j, at = at_sites(p, site, s)
    x, y = p.X[at] / sd, p.y[at]
    if leave:  # kernels weigh a distance of 0 by 1
        own = x[:, :, None] * x[:, None, :]
        A, b, squares, of = A[j] - own, b[j] - x * y[:, None], squares[j] - own, np.arange(len(j))
    else:
        of = j
    sv = np.ones((len(A), 2))
    if conditions or adjust:

        def exact(k: int) -> np.ndarray:
            w = np.repeat(W[j[k] if leave else k], s.rows)
            if leave:
                w[s.members == at[k]] = 0
            return w[:, None] * p.X[s.members]

        sv = column_condition(squares, exact)
    with np.errstate(all="ignore"):
        cn = np.where(sv[:, -1] > 0, sv[:, 0] / sv[:, -1], np.inf) if conditions or adjust else np.full(len(A), np.nan)
    own = np.where(adjust & (cn > limit), (sv[:, 0] - limit * sv[:, -1]) / (limit - 1), lam)
    A = A + own[:, None, None] * np.eye(c)
    beta, ok = solve(A, b)
    inv = np.linalg.inv(np.where(ok[:, None, None], A, np.eye(c)))
    C = inv @ squares @ inv
    s_ii = 0.0 if leave else np.einsum("mp,mpq,mq->m", x, inv[of], x)
    return pd.DataFrame({"fid": p.fid[at], "beta": list(beta[of] / sd), "lambda": own[of], "condition": cn[of], "raw": list(np.einsum("mpp->mp", C)[of] / sd**2), "s_ii": s_ii, "ss": np.einsum("mp,mpq,mq->m", x, C[of], x)})


def ridge_rows(df: DataFrame, p: Points, spec: Spec, lam: float, adjust: bool, limit: float, leave: bool = False) -> DataFrame:
    return over_sites(df, p, spec, (lam, adjust, limit, leave, not leave), ridge_sites, RIDGE, p.X.shape[1])


def ridge_gwr(df: DataFrame, y: str, xs: list[str], spec: Spec, lam: float = 0.0, adjust: bool = False, limit: float = 30.0) -> DataFrame:
    """Local ridge regression: coefficients, the ridge and condition number of each place (with ``adjust``, the ridge that brings the number to ``limit``), y, yhat, residual, SE and t values."""
    p, names = points(df, y, xs), names_of(xs)
    columns = [*names, "lambda", "condition", "y", "yhat", "residual", *(f"{n}_SE" for n in names), *(f"{n}_TV" for n in names)]
    if not len(p.fid):
        return nothing(df, columns)
    rows = ridge_rows(df, p, spec, lam, adjust, limit)
    f = gathered(rows)
    free(rows)
    beta = np.stack(f.beta)
    yhat = (beta * p.X).sum(1)
    rss = float(((p.y - yhat) ** 2).sum())
    with np.errstate(all="ignore"):
        se = np.sqrt(rss / (len(p.y) - 2 * f.s_ii.sum() + f.ss.sum()) * np.stack(f.raw))
        values = [*beta.T, f["lambda"].to_numpy(), f.condition.to_numpy(), p.y, yhat, p.y - yhat, *se.T, *(beta / se).T]
    return df.sparkSession.createDataFrame(pd.DataFrame({"fid": p.fid, **dict(zip(columns, values))}))


def ridge_diagnostics(df: DataFrame, y: str, xs: list[str], spec: Spec, lam: float = 0.0, adjust: bool = False, limit: float = 30.0) -> dict:
    """Residual sum, hat-matrix sums of the ridge solution and the scores made of them."""
    p = points(df, y, xs)
    if not len(p.fid):
        return {}
    rows = ridge_rows(df, p, spec, lam, adjust, limit)
    f = gathered(rows)
    free(rows)
    return diagnostics(p, float(((p.y - (np.stack(f.beta) * p.X).sum(1)) ** 2).sum()), float(f.s_ii.sum()), float(f.ss.sum()))


def ridge_cv(df: DataFrame, p: Points, spec: Spec, lam: float = 0.0, adjust: bool = False, limit: float = 30.0) -> float:
    rows = ridge_rows(df, p, spec, lam, adjust, limit, leave=True)
    f = gathered(rows)
    free(rows)
    out = float(((p.y - (np.stack(f.beta) * p.X).sum(1)) ** 2).sum())
    return out if math.isfinite(out) else math.inf


def ridge_bandwidth(df: DataFrame, y: str, xs: list[str], spec: Spec, lam: float = 0.0, adjust: bool = False, limit: float = 30.0, limits: tuple[float, float] | None = None) -> tuple[float, list[tuple[float, float]]]:
    """The bandwidth of the least leave-one-out error of the ridge solution."""
    p = points(df, y, xs)
    return select_bandwidth(df, p, spec, by=lambda s: ridge_cv(df, p, s, lam, adjust, limit), limits=limits)


def correlation_bandwidth(df: DataFrame, x: str, y: str, spec: Spec, criterion: str = "CV", limits: tuple[float, float] | None = None) -> tuple[float, list[tuple[float, float]]]:
    """The bandwidth of a pair of variables: that of the local regression of y on x through the origin."""
    return select_bandwidth(df, points(df, y, [x], intercept=False), spec, criterion, limits=limits)


def family_step(family: str, y: np.ndarray, nu: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mu, working response, working weights) of a Poisson or binomial model."""
    if family == "poisson":
        mu = y + 0.1 if nu is None else np.exp(nu)
        nu = np.log(mu) if nu is None else nu
        return mu, nu + (y - mu) / mu, mu
    mu = np.full(len(y), 0.5) if nu is None else 1 / (1 + np.exp(-np.clip(nu, -30, 30)))
    nu = np.zeros(len(y)) if nu is None else nu
    v = np.maximum(mu * (1 - mu), 2.2e-16)
    return mu, nu + (y - mu) / v, v


def log_likelihood(family: str, y: np.ndarray, mu: np.ndarray) -> float:
    if family == "poisson":
        return float((y * np.log(np.maximum(mu, 1e-300)) - mu - np.array([math.lgamma(v + 1) for v in y])).sum())
    return float((y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))).sum())


def glm(p: Points, family: str, most: int = 25, eps: float = 1e-8) -> dict:
    """Global generalised linear model by iterated least squares."""
    nu, last = None, math.inf
    for _ in range(most):
        mu, z, v = family_step(family, p.y, nu)
        beta = np.linalg.solve((p.X * v[:, None]).T @ p.X, (p.X * v[:, None]).T @ z)
        nu = p.X @ beta
        ll = log_likelihood(family, p.y, family_step(family, p.y, nu)[0])
        if abs(ll - last) / (abs(ll) + 0.1) < eps:
            break
        last = ll
    mu, _, v = family_step(family, p.y, nu)
    n, k = p.X.shape
    se = np.sqrt(np.diag(np.linalg.inv((p.X * v[:, None]).T @ p.X)))
    dev, null = deviance(family, p.y, mu), deviance(family, p.y, np.full(n, p.y.mean()))
    return {"beta": beta, "se": se, "log_likelihood": ll, "deviance": dev, "null_deviance": null, "pseudo_r2": 1 - dev / null, "aic": dev + 2 * k, "aicc": dev + 2 * k + 2 * k * (k + 1) / (n - k - 1)}


def deviance(family: str, y: np.ndarray, mu: np.ndarray) -> float:
    """Poisson deviance; for binomial data the sum of -2 log of each row's chance of what it is."""
    if family == "poisson":
        with np.errstate(all="ignore"):
            return float(np.where(y != 0, 2 * (y * (np.log(y / mu) - 1) + mu), 2 * mu).sum())
    return float((-2 * np.log(np.maximum(np.abs(y - 1 + mu), 1e-300))).sum())


def generalized_cv(df: DataFrame, p: Points, spec: Spec, family: str = "poisson", tol: float = 1e-5, most: int = 20) -> float:
    """Squared errors of the means predicted without the point itself."""
    _, mu, _ = generalized_fit(df, p, spec, family, tol, most, leave=True)
    out = float(((p.y - mu) ** 2).sum())
    return out if math.isfinite(out) else math.inf


def generalized_gwr(df: DataFrame, y: str, xs: list[str], spec: Spec, family: str = "poisson", tol: float = 1e-5, most: int = 20, select_bw: str | None = None) -> tuple[DataFrame, dict]:
    """Local Poisson or binomial regression: every iteration is one pass of weighted local fits, the first with even working weights.

    Rows have coefficients, y, yhat, residual, SE and t values; diagnostics the deviance with AIC, AICc and pseudo R2. ``select_bw`` takes the bandwidth of the least AICc or CV.
    """
    if large(df) and not select_bw:
        return tiles.generalized(tiles.state(df, y, xs), names_of(xs), spec, family, tol, most)
    p = points(df, y, xs)
    if not len(p.fid):
        names = names_of(xs)
        return nothing(df, [*names, "y", "yhat", "residual", *(f"{n}_SE" for n in names), *(f"{n}_TV" for n in names)]), {}
    if select_bw:
        by = {"AICc": lambda s: generalized_fit(df, p, s, family, tol, most)[2]["aicc"], "CV": lambda s: generalized_cv(df, p, s, family, tol, most)}[select_bw]
        spec = with_size(spec, select_bandwidth(df, p, spec, by=by)[0])
    f, mu, diag = generalized_fit(df, p, spec, family, tol, most)
    beta, se = np.stack(f.beta), np.sqrt(np.stack(f.raw))
    names = names_of(xs)
    out = pd.DataFrame({"fid": p.fid, **{n: beta[:, k] for k, n in enumerate(names)}, "y": p.y, "yhat": mu, "residual": p.y - mu, **{f"{n}_SE": se[:, k] for k, n in enumerate(names)}, **{f"{n}_TV": beta[:, k] / se[:, k] for k, n in enumerate(names)}})
    return df.sparkSession.createDataFrame(out), diag | {"bandwidth": spec.size}


def generalized_rounds(df: DataFrame, p: Points, spec: Spec, family: str, tol: float, most: int, leave: bool = False) -> tuple[pd.DataFrame, np.ndarray, float, np.ndarray, np.ndarray]:
    """The last local fits, the means they give and their log-likelihood, and the working response and weights that they were fitted to."""
    nu, last, v = None, 0.0, np.ones(len(p.y))
    for step in range(most):
        _, z, _ = family_step(family, p.y, nu)
        f = fitted(df, Points(p.fid, p.xy, p.X, z), spec, v, noise=1 / v)
        nu = z - f.cv.to_numpy() if leave else (np.stack(f.beta) * p.X).sum(1)
        mu, _, working = family_step(family, p.y, nu)
        ll = log_likelihood(family, p.y, mu)
        if step == most - 1 or not math.isfinite(ll) or abs((last - ll) / ll) < tol:
            break
        last, v = ll, working
    return f, mu, ll, z, v


def generalized_fit(df: DataFrame, p: Points, spec: Spec, family: str, tol: float, most: int, leave: bool = False) -> tuple[pd.DataFrame, np.ndarray, dict]:
    """The last local fits, the means, and diagnostics. ``leave``: each point is left out of its own fits, so that the means are predictions."""
    f, mu, ll, _, _ = generalized_rounds(df, p, spec, family, tol, most, leave)
    n, trace, dev = len(p.y), float(f.s_ii.sum()), deviance(family, p.y, mu)
    null = deviance(family, p.y, np.full(n, p.y.mean()))
    aic = dev + 2 * trace
    aicc = aic + 2 * trace * (trace + 1) / (n - trace - 1) if n - trace - 1 > 0 and math.isfinite(aic) else math.inf
    return f, mu, {"log_likelihood": ll, "deviance": dev, "null_deviance": null, "pseudo_r2": 1 - dev / null, "tr_s": trace, "tr_sts": float(f.ss.sum()), "aic": aic, "aicc": aicc}


def generalized_predict(df: DataFrame, focus: DataFrame, y: str, xs: list[str], spec: Spec, family: str = "poisson", tol: float = 1e-5, most: int = 20) -> DataFrame:
    """Coefficients at other points, without the hat matrix: the rounds run at the data points (MOST_POINTS at most), and each focus is
    fitted to their last working response with its kernel weights times the working weights. ``yhat`` is the mean where foci hold all
    variables. Foci without weight have null coefficients and ``ok`` false; without data there are no rows.
    """
    p, names = points(df, y, xs), names_of(xs)
    if not len(p.fid):
        return nothing(df, [*names, *(["yhat"] if set(xs) <= set(focus.columns) else [])]).withColumn("ok", F.lit(True))
    _, _, _, z, v = generalized_rounds(df, p, spec, family, tol, most)
    rows = local_fit(focus, Points(p.fid, p.xy, p.X, z), spec, v).select("fid", *(F.nanvl(F.col("beta")[k], F.lit(None).cast("double")).alias(n) for k, n in enumerate(names)), "ok")
    if not set(xs) <= set(focus.columns):
        return rows
    own = focus.select(F.col("fid").cast("long").alias("fid"), *(F.col(f"`{x}`").cast("double").alias(f"own_{x}") for x in xs))
    nu = F.col("Intercept")
    for x in xs:
        nu = nu + F.col(f"`{x}`") * F.col(f"`own_{x}`")
    mean = F.exp(nu) if family == "poisson" else 1 / (1 + F.exp(-nu))
    return rows.join(own, "fid").select("fid", *(F.col(f"`{n}`") for n in names), mean.alias("yhat"), "ok")


def product_block(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """Fits with weights that are a product over one-dimensional distances in each independent variable."""
    p, specs, at = held
    i = np.searchsorted(p.fid, pdf.fid.to_numpy(np.int64))
    W = np.ones((len(i), len(p.fid)))
    for k, s in enumerate(specs):
        v = p.X[:, k + 1]
        W *= weigh(s, np.abs(v[i][:, None] - v[None, :]))
    return fit_rows(W, p, p.fid[i])


def gtdr(df: DataFrame, y: str, xs: list[str], specs: list[Spec]) -> DataFrame:
    """Density regression: one bandwidth for each variable's own distance. Coefficients, y, yhat, residual and SE."""
    p = points(df, y, xs)
    if not len(p.fid):
        return nothing(df, [*names_of(xs), "y", "yhat", "residual", *(f"{n}_SE" for n in names_of(xs))]).withColumn("ok", F.lit(True))
    rows = over_foci(own_foci(df, p), (p, specs, None), product_block, FIT, len(p.fid))
    f = gathered(rows)
    free(rows)
    beta, names = np.stack(f.beta), names_of(xs)
    res = p.y - (beta * p.X).sum(1)
    se = np.sqrt((res**2).sum() / (len(p.y) - 2 * f.s_ii.sum() + f.ss.sum()) * np.stack(f.raw))
    out = {"fid": p.fid, **{n: beta[:, k] for k, n in enumerate(names)}, "y": p.y, "yhat": p.y - res, "residual": res, **{f"{n}_SE": se[:, k] for k, n in enumerate(names)}, "ok": f.ok.to_numpy()}
    return df.sparkSession.createDataFrame(pd.DataFrame(out))


def gtdr_cv(df: DataFrame, p: Points, specs: list[Spec]) -> float:
    rows = over_foci(own_foci(df, p), (p, specs, None), product_block, FIT, len(p.fid))
    v = rows.agg(F.sum(F.col("cv") * F.col("cv"))).first()[0]
    free(rows)
    return float(v) if v is not None and math.isfinite(v) else math.inf


def gtdr_bandwidths(df: DataFrame, y: str, xs: list[str], specs: list[Spec], rounds: int = 5, limits: list[tuple[float, float]] | None = None) -> tuple[list[Spec], float]:
    """Bandwidths of the least leave-one-out error, searched one variable after the other until a round changes none."""
    p, specs = points(df, y, xs), list(specs)
    best = gtdr_cv(df, p, specs)
    for _ in range(rounds):
        before = best
        for k, s in enumerate(specs):
            v = p.X[:, k + 1]
            low, high = limits[k] if limits else (20.0, float(len(p.fid))) if s.adaptive else (0.0, float(v.max() - v.min()))
            tried = golden(lambda b: gtdr_cv(df, p, [with_size(x, b) if j == k else x for j, x in enumerate(specs)]), low, high, s.adaptive)  # noqa: B023
            at = dict(tried[1])[tried[0]]
            if at < best:
                best, specs[k] = at, with_size(s, tried[0])
        if best >= before:
            break
    return specs, best


def multiscale_gwr(df: DataFrame, y: str, specs: dict[str, Spec], criterion: str = "dCVR", tol: float = 1e-6, most: int = 500, retries: int = 5, select: bool = False, near: float = 1e-6, centre: tuple[str, ...] = (), hat: bool = False, select_by: str = "CV", limits: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict]:
    """Back-fitting: each variable's coefficient is fitted alone, with its own bandwidth, to what the others leave over; a bandwidth picked alike (to ``near``) ``retries`` times is frozen. ``converged`` tells whether ``tol`` was reached within ``most`` rounds. Variables in ``centre`` are taken from their mean. ``hat``: each variable's hat matrix is carried through the rounds, some columns in each task (``hats.backfitted``), and gives SE, t values and diagnostics. Fits and scores are sums over the places of points, by tasks; those of a frozen bandwidth go by the factors of its weights where these are smooth (``hats.factor``), so that hundreds of rounds cost little. ``select`` picks bandwidths by ``select_by`` (CV or AIC of the variable's own fit) within each variable's ``limits``, by default from LEAST_POINTS points on."""
    xs = [v for v in specs if v != "Intercept"]
    p, spark = points(df, y, xs, most=MULTISCALE_POINTS), df.sparkSession
    if not len(p.fid):
        return nothing(df, [*names_of(xs), "y", "yhat", "residual", *(f"{n}_{k}" for n in names_of(xs) if hat for k in ("SE", "TV"))]), {}
    for v in centre:
        p.X[:, 1 + xs.index(v)] -= p.X[:, 1 + xs.index(v)].mean()
    own = [specs.get(n, next(iter(specs.values()))) for n in names_of(xs)]
    c = len(own)
    places, s = sites_of(p, None, False, None)
    if (m := len(s.rows)) > MOST_POINTS:
        raise ValueError(f"{m} places: more than {MOST_POINTS} are too many")
    at = np.empty(len(p.fid), np.int64)
    at[s.members] = np.repeat(np.arange(m), s.rows)
    added = lambda v: np.bincount(at, v, m)

    def sums(k: int, rest: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
        """Of each place the weighted squares of variable ``k`` and its products with what is left over; NaN squares where nothing can be fitted."""
        x = p.X[:, k]
        A, b = place_sums(spark, places, s.rows, spec, np.column_stack([added(x * x), added(x * rest)])).T
        return np.where(np.isfinite(A) & (A != 0), A, np.nan), b

    def cv(k: int, rest: np.ndarray, spec: Spec) -> float:
        x, (A, b) = p.X[:, k], sums(k, rest, spec)
        with np.errstate(all="ignore"):
            if select_by == "AIC":
                v = aicc_of(len(x), float(((rest - (b / A)[at] * x) ** 2).sum()), float((x * x / A[at]).sum()))
            else:  # each point left out of the sums of its place, where its weight is 1
                v = float(((rest - x * (b[at] - x * rest) / (A[at] - x * x)) ** 2).sum())
        return v if math.isfinite(v) else math.inf

    found = place_sums(spark, places, s.rows, own[0], s.sums)
    beta = solve(found[:, : c * c].reshape(-1, c, c), found[:, c * c :])[0][at]
    first, steps, kept = own[0], [], {}
    XX = s.sums[:, : c * c].reshape(-1, c, c)
    rss, stable, rounds = float(((p.y - (beta * p.X).sum(1)) ** 2).sum()), [0] * c, 0
    change = math.inf
    for rounds in range(1, most + 1):
        for k, spec in enumerate(own):
            rest = p.y - (beta * p.X).sum(1) + beta[:, k] * p.X[:, k]
            if select and stable[k] < retries:
                one = Points(p.fid, p.xy, p.X[:, [k]], rest)
                ends = (limits or {}).get(names_of(xs)[k]) or ((float(LEAST_POINTS["multiscale"]), float(len(p.fid))) if spec.adaptive else None)
                b = select_bandwidth(df, one, spec, "CV", by=lambda x: cv(k, rest, x), limits=ends)[0]  # noqa: B023
                stable[k] = stable[k] + 1 if abs(b - spec.size) <= near else 0
                own[k] = spec = with_size(spec, b)
            smooth = None if select and stable[k] < retries else hats.smoothed(spark, places, s.rows, XX[:, k, k], k, spec, kept)
            A, b = (smooth[1], smooth[0] @ (smooth[0].T @ added(p.X[:, k] * rest))) if smooth else sums(k, rest, spec)
            beta[:, k] = (b / A)[at]
            steps.append((k, spec))
        new = float(((p.y - (beta * p.X).sum(1)) ** 2).sum())
        change = abs(new - rss) if criterion == "CVR" else math.sqrt(abs(new - rss) / max(new, 1e-300))
        rss = new
        if change <= tol:
            break
    yhat = (beta * p.X).sum(1)
    out = pd.DataFrame({"fid": p.fid, **{n: beta[:, k] for k, n in enumerate(names_of(xs))}, "y": p.y, "yhat": yhat, "residual": p.y - yhat})
    more = {}
    if hat:
        tr, ss, squares = hats.backfitted(spark, p, first, steps)
        more = diagnostics(p, rss, tr, ss)
        with np.errstate(all="ignore"):
            for k, n in enumerate(names_of(xs)):
                out[f"{n}_SE"] = np.sqrt(rss / (len(p.y) - 2 * tr + ss) * squares[:, k])
                out[f"{n}_TV"] = beta[:, k] / out[f"{n}_SE"]
    return spark.createDataFrame(out), more | {"rss": rss, "rounds": rounds, "change": change, "converged": change <= tol, "bandwidths": {n: s.size for n, s in zip(names_of(xs), own)}}


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.01, size: float = 1e-6, most: int = 500) -> np.ndarray:
    """Nelder-Mead minimum."""
    pts = [start] + [start + step * e for e in np.eye(len(start))]
    val = [f(q) for q in pts]
    for _ in range(most):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if max(np.abs(q - pts[0]).max() for q in pts) < size:
            break
        mid = np.mean(pts[:-1], 0)
        tried = mid + (mid - pts[-1])
        v = f(tried)
        if v < val[0]:
            far = mid + 2 * (mid - pts[-1])
            w = f(far)
            pts[-1], val[-1] = (far, w) if w < v else (tried, v)
        elif v < val[-2]:
            pts[-1], val[-1] = tried, v
        else:
            near = mid + 0.5 * (pts[-1] - mid)
            w = f(near)
            if w < val[-1]:
                pts[-1], val[-1] = near, w
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (q - pts[0]) for q in pts[1:]]
                val = [val[0]] + [f(q) for q in pts[1:]]
    return pts[int(np.argmin(val))]


#: By what the median neighbour distance is divided for the base bandwidth of each kernel.
BASE_SHARE = {"gaussian": math.sqrt(3), "exponential": 3.0}


def base_weights(p: Points, foci_at: np.ndarray, k: int, band: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points of data points, themselves first, and the base kernel there."""
    d = distances(Spec(0), p.xy[foci_at], p.xy)
    d[np.arange(len(foci_at)), foci_at] = -1
    near = np.argsort(d, 1, kind="stable")[:, :k]
    return near, np.exp(-((np.maximum(np.take_along_axis(d, near, 1), 0) / band) ** 2))


def moments_block(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """Kernel moments of the nearest points of each focus, itself left out, for each power of the base kernel."""
    p, k, band, powers = held
    i = np.searchsorted(p.fid, pdf.fid.to_numpy(np.int64))
    near, g = base_weights(p, i, k, band)
    X, y = p.X[near[:, 1:]], p.y[near[:, 1:]]
    M, m = [], []
    for q in powers:
        w = g[:, 1:] ** q
        M.append(np.einsum("mk,mkp,mkq->mpq", w, X, X))
        m.append(np.einsum("mk,mkp,mk->mp", w, X, y))
    return pd.DataFrame({"fid": p.fid[i], "M": [x.ravel() for x in np.stack(M, 1)], "m": [x.ravel() for x in np.stack(m, 1)]})


def neighbour_block(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """Distance of each focus to its k-th nearest point, itself counted."""
    p, k = held
    i = np.searchsorted(p.fid, pdf.fid.to_numpy(np.int64))
    return pd.DataFrame({"fid": p.fid[i], "d": np.partition(distances(Spec(0), p.xy[i], p.xy), k - 1, 1)[:, k - 1]})


def scalable_block(pdf: pd.DataFrame, held) -> pd.DataFrame:
    p, k, band, powers, shares, penalty = held
    fid = pdf.fid.to_numpy(np.int64)
    i = np.searchsorted(p.fid, fid)
    near, g = base_weights(p, i, k, band)
    W = np.full((len(i), len(p.fid)), penalty)
    np.put_along_axis(W, near, penalty + sum(r * g**q for r, q in zip(shares, powers)), 1)
    return fit_rows(W, p, fid)


def scalable_gwr(df: DataFrame, y: str, xs: list[str], k: int = 50, polynomial: int = 4, kernel: str = "gaussian", criterion: str = "CV") -> tuple[DataFrame, dict]:
    """Kernel as a polynomial of a fixed base kernel over the ``k`` nearest points, plus a global share for all points.

    The base bandwidth is the median distance to the k-th (50th at most) nearest point, of all points, over a fixed share
    of the ``kernel``. The polynomial's terms have powers 0 and 2**(P/2)/2**p; their shares are powers of one scale,
    normalised. Scale and global share minimise the leave-one-out error, a point left out of both parts, or with
    ``criterion`` AICc that of the fit. Rows have coefficients, y, yhat, residual, SE and t values. Beyond MOST_POINTS the
    same goes over tables.
    """
    if large(df) and large(rows := tiles.state(df, y, xs)):
        return scalable_tables(rows, xs, k, polynomial, kernel, criterion)
    p = points(df, y, xs)
    n, c = p.X.shape
    if not n:
        return nothing(df, [*names_of(xs), "y", "yhat", "residual", *(f"{v}_{q}" for v in names_of(xs) for q in ("SE", "TV"))]), {}
    k = min(k, n - 1)
    near = over_foci(own_foci(df, p), (p, min(50, k)), neighbour_block, "fid bigint, d double", n)
    band = float(np.median(near.select("d").toPandas().d)) / BASE_SHARE[kernel] or 1.0
    free(near)
    powers = [0.0, *(2 ** (polynomial / 2) / 2 ** (q + 1) for q in range(polynomial))]
    rows = over_foci(own_foci(df, p), (p, k, band, powers), moments_block, "fid bigint, M array<double>, m array<double>", n)
    got = rows.toPandas().sort_values("fid")
    free(rows)
    M, m = np.stack(got.M).reshape(n, len(powers), c, c), np.stack(got.m).reshape(n, len(powers), c)
    A0, b0 = p.X.T @ p.X, p.X.T @ p.y
    own, own_y = p.X[:, :, None] * p.X[:, None, :], p.X * p.y[:, None]

    def shares_of(par: np.ndarray) -> tuple[np.ndarray, float]:
        r = np.array([(par[0] ** 2) ** (q + 1) for q in range(len(powers))])
        return r / r.sum() if r.sum() > 0 else r, float(par[1] ** 2)

    def objective(par: np.ndarray) -> float:
        r, a = shares_of(par)
        A = np.einsum("q,nqij->nij", r, M) + a * (A0 - own)
        v = np.einsum("q,nqi->ni", r, m) + a * (b0 - own_y)
        if criterion == "CV":
            e = p.y - (solve(A, v)[0] * p.X).sum(1)
            return float((e**2).sum()) if np.isfinite(e).all() else math.inf
        A, v = A + (r.sum() + a) * own, v + (r.sum() + a) * own_y
        both, ok = solve(A, np.stack([v, p.X], 2))
        e = p.y - (both[:, :, 0] * p.X).sum(1)
        out = aicc_of(n, float((e**2).sum()), float((r.sum() + a) * (both[:, :, 1] * p.X).sum()))
        return out if ok.all() and math.isfinite(out) else math.inf

    par = simplex(objective, np.array([1.0, 0.01]))
    r, a = shares_of(par)
    fits = over_foci(own_foci(df, p), (p, k, band, powers, r, a), scalable_block, FIT, n)
    f = fits.toPandas().sort_values("fid", kind="stable")
    free(fits)
    beta = np.stack(f.beta)
    res = p.y - (beta * p.X).sum(1)
    s, ss, rss = float(f.s_ii.sum()), float(f.ss.sum()), float((res**2).sum())
    se = np.sqrt(rss / (n - 2 * s + ss) * np.stack(f.raw))
    names = names_of(xs)
    out = pd.DataFrame({"fid": p.fid, **{v: beta[:, j] for j, v in enumerate(names)}, "y": p.y, "yhat": p.y - res, "residual": res, **{f"{v}_SE": se[:, j] for j, v in enumerate(names)}, **{f"{v}_TV": beta[:, j] / se[:, j] for j, v in enumerate(names)}})
    return df.sparkSession.createDataFrame(out), diagnostics(p, rss, s, ss) | {"scale": float(par[0] ** 2), "penalty": a, "score": objective(par), "band": band}


def neighbours_in(pdf: pd.DataFrame, c: int, band: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The base kernel, the design rows and the responses of the nearest others of each point, from its place's list: the point itself is left out, or the last where the list ends before it."""
    ids = np.stack(pdf.ids)
    at = np.where((own := ids == pdf.fid.to_numpy(np.int64)[:, None]).any(1), own.argmax(1), ids.shape[1] - 1)
    on = np.arange(ids.shape[1]) != at[:, None]
    part = lambda v, *wide: v.reshape(*ids.shape, *wide)[on].reshape(len(ids), -1, *wide)
    return np.exp(-((part(np.stack(pdf.ds)) / band) ** 2)), part(np.stack(pdf.rows), c), part(np.stack(pdf.zs))


def scalable_sums(G: np.ndarray, X: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products by weight of each row's points."""
    return np.einsum("mk,mkp,mkq->mpq", G, X, X), np.einsum("mk,mkp,mk->mp", G, X, z)


def ranked(values: DataFrame, at: list[int]) -> list[float]:
    """Which values (``d``, each with its number of rows ``n``) stand at these places of their order, from 0; counts narrow them down until few are left."""
    once = written(values.groupBy("d").agg(F.sum("n").alias("n")))
    found = []
    for k in at:
        low, high, before = *once.agg(F.min("d"), F.max("d")).first(), 0
        while low < high:
            inside = once.filter(F.col("d").between(low, high))
            if inside.count() <= 100_000:
                few = inside.toPandas().sort_values("d")
                low = high = float(few.d.to_numpy()[np.searchsorted(few.n.cumsum().to_numpy(), k - before, side="right")])
                break
            part = F.least(F.floor((F.col("d") - low) / (high - low) * 1024), F.lit(1023))
            for r in inside.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).orderBy("part").collect():  # 1,024 at most
                low, high = r["low"], r["high"]
                if before + r["n"] > k:
                    break
                before += r["n"]
        found.append(low)
    dropped(once)
    return found


def scalable_tables(state: DataFrame, xs: list[str], k: int, polynomial: int, kernel: str, criterion: str) -> tuple[DataFrame, dict]:
    """``scalable_gwr`` of any number of points (rows of ``tiles.state``): each place has one list of its nearest points, moments and fits are tables, a step of the search is one row of sums."""
    rows, c = written(state), len(xs) + 1
    once = sites.of(rows, {"n": F.count("*")})
    n = rows.count()
    k = min(k, n - 1)
    near = written(neighbours.nearest(once, rows, k))
    band = float(np.mean(ranked(near.filter(F.col("rank") == min(50, k)).join(once, "fid").select("d", "n"), [(n - 1) // 2, n // 2]))) / BASE_SHARE[kernel] or 1.0
    found = near.join(rows.select(F.col("fid").alias("d_fid"), "z", "row"), "d_fid").groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("rank", "d_fid", "d", "z", "row"))).alias("near"))
    lists = once.join(found, "fid").select("x", "y", F.col("near.d_fid").alias("ids"), F.col("near.d").alias("ds"), F.col("near.z").alias("zs"), F.flatten("near.row").alias("rows"))
    lists = written(lists)
    met = rows.select("fid", "x", "y", "z", "row").join(lists, ["x", "y"]).drop("x", "y")
    powers = [0.0, *(2 ** (polynomial / 2) / 2 ** (q + 1) for q in range(polynomial))]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g, X, z = neighbours_in(pdf, c, band)
            M, m = zip(*(scalable_sums(g**q, X, z) for q in powers))
            block = np.column_stack([pdf.z, np.stack(pdf.row), np.stack(M, 1).reshape(len(pdf), -1), np.stack(m, 1).reshape(len(pdf), -1)])
            yield pd.DataFrame({"block": [block.astype("<f8").tobytes()]})

    # each step of the search reads these: a row for each batch of points, so that nothing is unpacked
    held = written(met.mapInPandas(moments, "block binary"))
    G = gram(rows, [*(F.col("row")[j] for j in range(c)), F.col("z")])
    A0, b0 = G[:c, :c], G[:c, c]

    def shares_of(par: np.ndarray) -> tuple[np.ndarray, float]:
        r = np.array([(par[0] ** 2) ** (q + 1) for q in range(len(powers))])
        return r / r.sum() if r.sum() > 0 else r, float(par[1] ** 2)

    def objective(par: np.ndarray) -> float:
        r, a = shares_of(par)

        def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for raw in (raw for pdf in batches for raw in pdf.block):
                v = np.frombuffer(raw, "<f8").reshape(-1, 1 + c + len(powers) * (c * c + c))
                z, x, xx, xy = np.split(v, [1, 1 + c, 1 + c + len(powers) * c * c], axis=1)
                z, own = z[:, 0], x[:, :, None] * x[:, None, :]
                own_y = x * z[:, None]
                A = np.einsum("q,nqij->nij", r, xx.reshape(len(z), -1, c, c)) + a * (A0 - own)
                v = np.einsum("q,nqi->ni", r, xy.reshape(len(z), -1, c)) + a * (b0 - own_y)
                if criterion == "CV":
                    e, s = z - (solve(A, v)[0] * x).sum(1), 0.0
                else:
                    both, _ = solve(A + (r.sum() + a) * own, np.stack([v + (r.sum() + a) * own_y, x], 2))
                    e, s = z - (both[:, :, 0] * x).sum(1), float((r.sum() + a) * (both[:, :, 1] * x).sum())
                yield pd.DataFrame({"rss": [float((e**2).sum())], "s": [s]})

        rss, s = held.mapInPandas(errors, "rss double, s double").agg(F.sum("rss"), F.sum("s")).first()
        out = rss if criterion == "CV" else aicc_of(n, rss, s)
        return out if math.isfinite(out) else math.inf

    par = simplex(objective, np.array([1.0, 0.01]))
    r, a = shares_of(par)

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g, X, z = neighbours_in(pdf, c, band)
            x, y = np.stack(pdf.row), pdf.z.to_numpy(float)
            w, own = sum(u * g**q for u, q in zip(r, powers)), r.sum()  # kernels weigh a distance of 0 by 1
            A, b = scalable_sums(w, X, z)
            A, b = A + a * A0 + own * x[:, :, None] * x[:, None, :], b + a * b0 + own * x * y[:, None]
            B = scalable_sums(w * (w + 2 * a), X, z)[0] + a * a * A0 + own * (own + 2 * a) * x[:, :, None] * x[:, None, :]
            beta, ok = solve(A, b)
            inv = np.linalg.inv(np.where(ok[:, None, None], A, np.eye(c)))
            C = inv @ B @ inv
            yield pd.DataFrame({"fid": pdf.fid, "y": y, "beta": list(beta), "raw": list(np.einsum("mpp->mp", C)), "s_ii": (own + a) * np.einsum("mp,mpq,mq->m", x, inv, x), "ss": np.einsum("mp,mpq,mq->m", x, C, x), "residual": y - (beta * x).sum(1)})

    done = written(met.mapInPandas(fits, "fid bigint, y double, beta array<double>, raw array<double>, s_ii double, ss double, residual double"))
    s, ss, rss, variance = done.agg(F.sum("s_ii"), F.sum("ss"), F.sum(F.col("residual") * F.col("residual")), F.var_pop("y")).first()
    score, names = objective(par), names_of(xs)
    dropped(near, lists, held, once, rows)
    se = lambda j: F.sqrt(F.lit(rss / (n - 2 * s + ss)) * F.col("raw")[j])
    out = done.select("fid", *(F.col("beta")[j].alias(v) for j, v in enumerate(names)), "y", (F.col("y") - F.col("residual")).alias("yhat"), "residual", *(se(j).alias(f"{v}_SE") for j, v in enumerate(names)), *((F.col("beta")[j] / se(j)).alias(f"{v}_TV") for j, v in enumerate(names)))
    return out, tiles.scores(n, n * variance, rss, s, ss) | {"scale": float(par[0] ** 2), "penalty": a, "score": score, "band": band}


def pca_block(pdf: pd.DataFrame, held) -> pd.DataFrame:
    spec, p, k, robust = held
    W = weights_of(spec, p, pdf[["x", "y"]].to_numpy(float))
    out = []
    for fid, w in zip(pdf.fid, W):
        on = w > 0
        if on.sum() <= 5:
            out.append((fid, None, None, None, None))
            continue
        X, v = p.X[on], w[on]
        if robust:
            Z = (X - X[np.argmin(np.abs(v - 0.5))]) * v[:, None]
            Z = Z - Z.mean(0)
        else:
            Z = (X - (v @ X) / v.sum()) * np.sqrt(v / v.sum())[:, None]
        val, vec = np.linalg.eigh(Z.T @ Z)
        val, vec = np.maximum(val[::-1], 0), vec[:, ::-1]
        vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
        pv = 100 * val / val.sum() if val.sum() > 0 else np.full(len(val), np.nan)
        out.append((fid, list(pv[:k]), float(pv[:k].sum()), int(vec[:, 0].argmax()), list(vec[:, :k].T.ravel())))
    return pd.DataFrame(out, columns=["fid", "pv", "local_CP", "win", "loadings"])


def gwpca(df: DataFrame, variables: list[str], k: int, spec: Spec, robust: bool = False) -> DataFrame:
    """Local principal components: percent of variance, its sum, the variable that leads the first component, loadings (component by component). Null below six weighted points."""
    p = points(df, None, variables, intercept=False)
    rows = over_foci(own_foci(df, p), (spec, p, k, robust), pca_block, "fid bigint, pv array<double>, local_CP double, win int, loadings array<double>", len(p.fid))
    names = F.array(*map(F.lit, variables))
    return rows.select("fid", *(F.col("pv")[j].alias(f"Comp.{j + 1}_PV") for j in range(k)), "local_CP", F.when(F.col("win").isNotNull(), F.try_element_at(names, F.col("win") + 1)).alias("win_var_PC1"), "loadings")


def components_of(X: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The first k local components as columns."""
    Z = (X - (w @ X) / w.sum()) * np.sqrt(w / w.sum())[:, None]
    vec = np.linalg.eigh(Z.T @ Z)[1][:, ::-1][:, :k]
    return vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])


def score_sites(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """Of each place with six points in reach: the points there, the places in reach, and the loadings of the first k components, one after the other."""
    spec, places, s, p, k = held
    of, out = np.empty(len(p.fid), np.int64), []
    of[s.members] = np.repeat(np.arange(len(s.rows)), s.rows)
    for site, w in zip(pdf.fid, weights_of(spec, places, pdf[["x", "y"]].to_numpy(float), rows=s.rows)):
        v = w[of]
        on = v > 0
        if on.sum() > 5:
            own = s.members[s.first[site] : s.first[site] + s.rows[site]]
            out.append((p.fid[own], np.flatnonzero(w > 0).astype(np.int32), components_of(p.X[on], v[on], k).T.ravel()))
    return pd.DataFrame(out, columns=["fids", "near", "loadings"])


def points_of_sites(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """The points at each of the places with their variables."""
    _, _, s, p, _ = held
    site = pdf.fid.to_numpy(np.int64)
    j, at = at_sites(p, site, s)
    return pd.DataFrame({"place": site[j].astype(np.int32), "d_fid": p.fid[at], "row": list(p.X[at])})


def gwpca_scores(df: DataFrame, variables: list[str], k: int, spec: Spec, digits: int | None = None) -> DataFrame:
    """``fid, d_fid, Comp.1 ...``: what each point in a focus's reach scores on the focus's components, rounded to so many ``digits`` if given. A row for each pair with weight.

    Components and scores are made once a place, in rows of places with the places in reach; pairs come of these at the end, a
    score behind itself for all foci of a place, so that files hold it once.
    """
    p, c = points(df, None, variables, intercept=False, most=SCORED_POINTS), len(variables)
    rows = over_sites(df, p, spec, (k,), score_sites, "fids array<bigint>, near array<int>, loadings array<double>", c)
    at = over_sites(df, p, spec, (k,), points_of_sites, "place int, d_fid bigint, row array<double>", c)
    at = at.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("d_fid", "row"))).alias("members"))
    met = rows.select("fids", "loadings", F.explode("near").alias("place")).join(F.broadcast(at), "place").select("fids", "loadings", F.inline("members"))
    scores = [reduce(add, (F.col("row")[q] * F.get("loadings", F.lit(j * c + q)) for q in range(c))) for j in range(k)]
    scores = scores if digits is None else [F.round(v, digits) for v in scores]
    return met.select("fids", "d_fid", *(v.alias(f"Comp.{j + 1}") for j, v in enumerate(scores))).select(F.explode("fids").alias("fid"), "d_fid", *(f"`Comp.{j + 1}`" for j in range(k)))


def pca_cv_sites(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """For all points at each place what the first k components of the others, by the weighted covariances of places, leave over of them."""
    spec, places, s, p, k, mean = held
    W, c = weights_of(spec, places, pdf[["x", "y"]].to_numpy(float), rows=s.rows), p.X.shape[1]
    j, at = at_sites(p, pdf.fid.to_numpy(np.int64), s)
    others = ((W > 0) @ s.rows)[j] - 1
    X = p.X[at] - mean
    # of sites: sums of products and of the variables themselves, which stand in the place of y; kernels weigh a distance of 0 by 1
    sums = (W @ np.column_stack([s.rows, s.sums[:, c * c :], s.sums[:, : c * c]]))[j] - np.column_stack([np.ones(len(at)), X, (X[:, :, None] * X[:, None, :]).reshape(len(X), -1)])
    with np.errstate(all="ignore"):
        m = sums[:, 1:] / sums[:, :1]
    cov = m[:, c:].reshape(-1, c, c) - m[:, :c, None] * m[:, None, :c]
    fine = (others > 1) & np.isfinite(cov).all((1, 2))
    V = np.linalg.eigh(np.where(fine[:, None, None], cov, np.eye(c)))[1][:, :, ::-1][:, :, :k]
    left = p.X[at] - np.einsum("mp,mpk,mqk->mq", p.X[at], V, V)
    return pd.DataFrame({"fid": p.fid[at], "cv": np.where(fine, left.sum(1) ** 2, np.inf)})


def gwpca_cv(df: DataFrame, p: Points, spec: Spec, k: int) -> float:
    """Squared sums of what the first k components of the others leave over of each point."""
    mean = p.X.mean(0) if len(p.fid) else np.zeros(p.X.shape[1])
    rows = over_sites(df, p, spec, (k, mean), pca_cv_sites, "fid bigint, cv double", p.X.shape[1], Points(p.fid, p.xy, p.X - mean, np.ones(len(p.fid))))
    out = rows.agg(F.sum("cv")).first()[0]
    free(rows)
    return float(out) if out is not None and math.isfinite(out) else math.inf


def gwpca_bandwidth(df: DataFrame, variables: list[str], k: int, spec: Spec, limits: tuple[float, float] | None = None) -> tuple[float, list[tuple[float, float]]]:
    p = points(df, None, variables, intercept=False)
    limits = limits or ((float(LEAST_POINTS["components"]), float(len(p.fid))) if spec.adaptive else None)
    return select_bandwidth(df, p, spec, by=lambda s: gwpca_cv(df, p, s, k), limits=limits)


def glyphs(pca: DataFrame, df: DataFrame, variables: list[str], length: float = 10.0) -> DataFrame:
    """Glyph lines: for each focus and variable a segment at its share of the circle, as long as the first loading."""
    n = len(variables)
    at = df.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = pca.select("fid", F.posexplode(F.slice("loadings", 1, n)).alias("k", "loading")).join(at, "fid")
    angle, size = F.col("k") * F.lit(2 * math.pi / n), F.abs("loading") * length
    return rows.select("fid", F.element_at(F.array(*map(F.lit, variables)), F.col("k") + 1).alias("variable"), "x", "y", (F.col("x") + size * F.sin(angle)).alias("to_x"), (F.col("y") + size * F.cos(angle)).alias("to_y"))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def f_cdf(x: float, d1: float, d2: float) -> float:
    """Distribution function of F."""
    if x <= 0:
        return 0.0
    z = d1 * x / (d1 * x + d2)
    a, b = d1 / 2, d2 / 2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z))
    return front * beta_fraction(a, b, z) / a if z < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - z) / b


def f_tests(df: DataFrame, y: str, xs: list[str], spec: Spec) -> dict:
    """F1, F2 and F4 (local against global fit) and F3 for each coefficient (does it vary): statistic, both degrees of freedom and probability.

    The traces are summed over pairs of blocks of hat rows (``hats.traces``), for MOST_POINTS points at most. A place
    with a singular system makes all of them NaN. No rows give no tests.
    """
    p, spark = points(df, y, xs), df.sparkSession
    n, c = p.X.shape
    if not n:
        return {}
    one, two = hats.traces(spark, p, spec)
    beta = np.stack(fitted(df, p, spec).beta)
    g1, g2 = float(one[0]), float(two[0])
    rss, o = float(((p.y - (beta * p.X).sum(1)) ** 2).sum()), ols(p)
    f1 = rss / g1 / (o["rss"] / (n - c))
    d1 = g1 * g1 / g2
    # the local fit leaves linear responses alone, so the product of the global projection and R is zero
    v1, v2 = n - c - g1, n - c - 2 * g1 + g2
    f2 = (o["rss"] - rss) / v1 / (o["rss"] / (n - c))
    out = {"F1": (f1, d1, n - c, f_cdf(f1, d1, n - c)), "F2": (f2, v1 * v1 / v2, n - c, 1 - f_cdf(f2, v1 * v1 / v2, n - c))}
    for k, name in enumerate(names_of(xs)):
        t1, t2 = float(one[1 + k]) / n, float(two[1 + k]) / n**2
        f3 = float(beta[:, k].var()) / t1 / (rss / g1)
        out[f"F3_{name}"] = (f3, t1 * t1 / t2, d1, 1 - f_cdf(f3, t1 * t1 / t2, d1))
    out["F4"] = (rss / o["rss"], g1, n - c, f_cdf(rss / o["rss"], g1, n - c))
    return out
