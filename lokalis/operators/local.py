"""Dense local fits: foci are dealt over tasks, the data points are broadcast behind a check of their number.

A task holds a block of foci against all points at a time, so its memory is bounded by the points.
Tables of more points than ``MOST_POINTS`` use the pair plans of ``pairs`` and ``summary``, which shuffle.
Rows with a null among coordinates or variables are dropped, or count as 0 with ``null_policy="zero"``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalis.functions import kernels

MOST_POINTS = 200_000
#: Focus-point pairs that a task works on at once.
BLOCK_PAIRS = 1_000_000


@dataclass(frozen=True)
class Spec:
    """Bandwidth ``size`` (distance, or number of points if ``adaptive``), kernel, and metric: euclidean, geographic, chebyshev, manhattan or a power."""

    size: float
    kernel: str = "gaussian"
    adaptive: bool = False
    metric: str | float = "euclidean"
    theta: float = 0.0
    time_scale: float = 0.0
    future: str = "include"


@dataclass
class Points:
    """Data in the order of ``fid``: coordinates, design matrix with the intercept first, response, optional time."""

    fid: np.ndarray
    xy: np.ndarray
    X: np.ndarray
    y: np.ndarray
    t: np.ndarray | None = None


def points(df: DataFrame, y: str | None, xs: list[str], t: str | None = None, intercept: bool = True, null_policy: str = "drop", most: int | None = None) -> Points:
    """Collect a table of at most ``most`` (MOST_POINTS) rows. Repeated ids are an error."""
    names = ["x", "y", *([y] if y else []), *xs, *([t] if t else [])]
    cols = [F.col(c).try_cast("double") for c in names]
    cols = [F.coalesce(c, F.lit(0.0)) for c in cols] if null_policy == "zero" else cols
    rows = df.select(F.col("fid").cast("long").alias("fid"), *(c.alias(f"v{k}") for k, c in enumerate(cols))).dropna()
    if (n := rows.count()) > (most or MOST_POINTS):
        raise ValueError(f"{n} points: more than {most or MOST_POINTS} need the pair plans")
    a = rows.toPandas().sort_values("fid", kind="stable")
    if a.fid.duplicated().any():
        raise ValueError("fid must be unique")
    v = a.drop(columns="fid").to_numpy(float)
    k = 2 + bool(y)
    X = v[:, k : k + len(xs)]
    X = np.column_stack([np.ones(len(v)), X]) if intercept else X
    return Points(a.fid.to_numpy(np.int64), v[:, :2], X, v[:, 2] if y else np.zeros(len(v)), v[:, -1] if t else None)


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    f, g, l = np.radians(a[:, None, 1] + b[None, :, 1]) / 2, np.radians(a[:, None, 1] - b[None, :, 1]) / 2, np.radians(a[:, None, 0] - b[None, :, 0]) / 2
    s = np.sin(g) ** 2 * np.cos(l) ** 2 + np.cos(f) ** 2 * np.sin(l) ** 2
    c = np.cos(g) ** 2 * np.cos(l) ** 2 + np.sin(f) ** 2 * np.sin(l) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.arctan(np.sqrt(s / c))
        r = np.sqrt(s * c) / w
        d = 2 * w * 6378.137 * (1 + (3 * r - 1) / (2 * c) / 298.257223563 * np.sin(f) ** 2 * np.cos(g) ** 2 - (3 * r + 1) / (2 * s) / 298.257223563 * np.cos(f) ** 2 * np.sin(g) ** 2)
    return np.where(s == 0, 0.0, d)


def distances(spec: Spec, a: np.ndarray, b: np.ndarray, at: np.ndarray | None = None, bt: np.ndarray | None = None) -> np.ndarray:
    if spec.metric == "geographic":
        d = great_circle(a, b)
    else:
        u, v = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
        if spec.theta and spec.metric != "euclidean":
            c, s = np.cos(spec.theta), np.sin(spec.theta)
            u, v = u * c - v * s, u * s + v * c
        if spec.metric != "euclidean":
            u, v = np.abs(u), np.abs(v)
        d = {"euclidean": lambda: np.sqrt(u * u + v * v), "chebyshev": lambda: np.maximum(u, v), "manhattan": lambda: u + v}.get(spec.metric, lambda: (u ** float(spec.metric) + v ** float(spec.metric)) ** (1 / float(spec.metric)))()
    if at is not None and bt is not None:
        d = np.sqrt(d * d + spec.time_scale * (at[:, None] - bt[None, :]) ** 2)
    return d


def weigh(spec: Spec, d: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights of distances; where columns are sites, ``rows`` has the number of data rows of each."""
    if not spec.adaptive:
        return kernels.weights(spec.kernel, d, spec.size)
    if rows is not None and spec.size <= rows.sum():
        order = np.argsort(d, axis=1)
        at = (np.cumsum(rows[order], axis=1) >= max(int(spec.size), 1)).argmax(1)
        b = d[np.arange(len(d)), order[np.arange(len(d)), at]]
        return kernels.weights(spec.kernel, d, b[:, None])
    n = d.shape[1] if rows is None else rows.sum()
    b = np.partition(d, min(max(int(spec.size), 1), n) - 1, axis=1)[:, min(max(int(spec.size), 1), n) - 1] if spec.size <= n else d.max(1) * spec.size / n
    return kernels.weights(spec.kernel, d, b[:, None])


def weights_of(spec: Spec, p: Points, xy: np.ndarray, t: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    w = weigh(spec, distances(spec, xy, p.xy, t, p.t if t is not None else None), rows)
    if t is not None and spec.future == "exclude":
        w = np.where(p.t[None, :] > t[:, None], 0.0, w)
    return w


def solve(A: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Batched solution; NaN and not ok where a system is singular."""
    with np.errstate(all="ignore"):
        ok = np.isfinite(A).all((1, 2)) & (np.linalg.cond(np.where(np.isfinite(A), A, 0)) < 1e14)
    safe = np.where(ok[:, None, None], A, np.eye(A.shape[1]))
    out = np.linalg.solve(safe, b[..., None] if b.ndim == 2 else b)
    out = out[..., 0] if b.ndim == 2 else out
    out[~ok] = np.nan
    return out, ok


def blocks(n: int, against: int) -> Iterator[slice]:
    step = max(1, BLOCK_PAIRS // max(1, against))
    for lo in range(0, n, step):
        yield slice(lo, min(n, lo + step))


def points_at(held, i: np.ndarray) -> pd.DataFrame:
    """Rows ``fid, x, y`` and perhaps ``t`` of the points in ``held`` at these places."""
    p = held if isinstance(held, Points) else next(v for v in held if isinstance(v, Points))
    return pd.DataFrame({"fid": p.fid[i], "x": p.xy[i, 0], "y": p.xy[i, 1]} | ({"t": p.t[i]} if p.t is not None else {}))


def over_foci(focus: DataFrame, held, f: Callable[[pd.DataFrame, object], pd.DataFrame], schema: str, points_held: int, ended: Callable[[], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Map foci (``fid, x, y`` and more, or ``own_foci``) in blocks against what is broadcast; foci are dealt over all cores. ``ended`` gives rows at a task's end. Eager callers ``free`` the result's broadcast."""
    sc = focus.sparkSession.sparkContext
    shared = sc.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = points_at(shared.value, pdf.i.to_numpy()) if "i" in pdf else pdf
            for s in blocks(len(pdf), points_held):
                yield f(pdf.iloc[s], shared.value)
        if ended:
            yield from ended()

    out = focus.repartition(max(1, sc.defaultParallelism)).mapInPandas(run, schema)
    out.held_by_tasks = shared
    return out


def free(rows: DataFrame) -> None:
    """Drop what ``over_foci`` broadcast for rows that have been read."""
    rows.held_by_tasks.destroy()


FIT = "fid bigint, beta array<double>, raw array<double>, s_ii double, ss double, cv double, ok boolean"


def fit_block(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """``fit_rows`` of each focus by its kernel weights; ``extra`` multiplies the points' weights, ``noise`` their variances."""
    spec, p, extra, noise = held
    t = pdf.t.to_numpy(float) if "t" in pdf else None
    W = weights_of(spec, p, pdf[["x", "y"]].to_numpy(float), t)
    return fit_rows(W if extra is None else W * extra[None, :], p, pdf.fid.to_numpy(np.int64), noise)


def fit_rows(W: np.ndarray, p: Points, fid: np.ndarray, noise: np.ndarray | None = None) -> pd.DataFrame:
    """Coefficients of each focus from its weights; where a focus is a data point also hat-matrix sums and the leave-one-out residual."""
    X, y = p.X, p.y
    if not len(p.fid):
        nothing = [[math.nan] * X.shape[1]] * len(fid)
        return pd.DataFrame({"fid": fid, "beta": nothing, "raw": nothing, "s_ii": math.nan, "ss": math.nan, "cv": math.nan, "ok": False})
    A = np.einsum("mn,np,nq->mpq", W, X, X, optimize=True)
    b = (W * y) @ X
    beta, ok = solve(A, b)
    inv = np.linalg.inv(np.where(ok[:, None, None], A, np.eye(A.shape[1])))
    B = np.einsum("mn,np,nq->mpq", W * W, X, X, optimize=True)
    C = inv @ B @ inv
    raw = np.einsum("mpp->mp", C if noise is None else inv @ np.einsum("mn,np,nq->mpq", W * W * noise, X, X, optimize=True) @ inv)
    at = np.minimum(np.searchsorted(p.fid, fid), len(p.fid) - 1)
    own = p.fid[at] == fid
    x, w = X[at], W[np.arange(len(at)), at]
    s_ii = np.where(own, w * np.einsum("mp,mpq,mq->m", x, inv, x), np.nan)
    ss = np.where(own, np.einsum("mp,mpq,mq->m", x, C, x), np.nan)
    loo, fine = solve(A - w[:, None, None] * x[:, :, None] * x[:, None, :], b - (w * y[at])[:, None] * x)
    cv = np.where(own & fine, y[at] - np.einsum("mp,mp->m", x, loo), np.where(own, np.inf, np.nan))
    return pd.DataFrame({"fid": fid, "beta": list(beta), "raw": list(raw), "s_ii": s_ii, "ss": ss, "cv": cv, "ok": ok})


@dataclass
class Sites:
    """What points of one place (and time) add to a fit: their number, sums of products by weight and squared weight, and the points themselves in the order of ``members`` from ``first`` on."""

    rows: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    members: np.ndarray
    first: np.ndarray


def sites_of(p: Points, extra: np.ndarray | None, t: bool, noise: np.ndarray | None) -> tuple[Points, Sites]:
    """The points' places as points of their own, and what is at them."""
    at = np.column_stack([p.xy, p.t]) if t else p.xy
    once, of, rows = np.unique(at + 0.0, axis=0, return_inverse=True, return_counts=True)
    of, m = of.ravel(), np.ones(len(p.fid)) if extra is None else extra
    XX = (p.X[:, :, None] * p.X[:, None, :]).reshape(len(p.fid), -1)
    members = np.argsort(of, kind="stable")
    first = np.searchsorted(of[members], np.arange(len(rows)))
    added = lambda v: np.add.reduceat(v[members], first) if len(first) else v
    squares = (m * m)[:, None] * XX
    squares = squares if noise is None else np.column_stack([squares, squares * noise[:, None]])
    places = Points(np.arange(len(rows)), once[:, :2], np.zeros((len(rows), 0)), np.zeros(len(rows)), once[:, 2] if t else None)
    return places, Sites(rows, added(m[:, None] * np.column_stack([XX, p.X * p.y[:, None]])), added(squares), members, first)


def fit_sites(pdf: pd.DataFrame, held) -> pd.DataFrame:
    """``fit_rows`` of all points at each of the places, whose systems they share."""
    spec, places, s, points_held, extra = held
    k, p = points_held.X.shape[1], points_held
    W = weights_of(spec, places, pdf[["x", "y"]].to_numpy(float), pdf.t.to_numpy(float) if "t" in pdf else None, s.rows)
    sums, squares = W @ s.sums, (W * W) @ s.squares
    A, b = sums[:, : k * k].reshape(-1, k, k), sums[:, k * k :]
    beta, ok = solve(A, b)
    inv = np.linalg.inv(np.where(ok[:, None, None], A, np.eye(k)))
    C = inv @ squares[:, : k * k].reshape(-1, k, k) @ inv
    raw = np.einsum("mpp->mp", inv @ squares[:, -k * k :].reshape(-1, k, k) @ inv)
    site = pdf.fid.to_numpy(np.int64)
    j = np.repeat(np.arange(len(site)), s.rows[site])  # the points of each place
    at = s.members[np.repeat(s.first[site], s.rows[site]) + np.arange(len(j)) - np.repeat(np.cumsum(s.rows[site]) - s.rows[site], s.rows[site])]
    x, y, w = p.X[at], p.y[at], (np.ones(len(at)) if extra is None else extra[at])  # kernels weigh a distance of 0 by 1
    loo, fine = solve(A[j] - w[:, None, None] * x[:, :, None] * x[:, None, :], b[j] - (w * y)[:, None] * x)
    cv = np.where(fine, y - np.einsum("mp,mp->m", x, loo), np.inf)
    return pd.DataFrame({"fid": p.fid[at], "beta": list(beta[j]), "raw": list(raw[j]), "s_ii": w * np.einsum("mp,mpq,mq->m", x, inv[j], x), "ss": np.einsum("mp,mpq,mq->m", x, C[j], x), "cv": cv, "ok": ok[j]})


def place_sums(spark: SparkSession, places: Points, rows: np.ndarray, spec: Spec, values: np.ndarray) -> np.ndarray:
    """What each place finds of the places' ``values`` (a row each) by its kernel weights: blocks of places are dealt over tasks, few are summed here."""
    m = len(rows)

    def some(own: slice, held) -> np.ndarray:
        places, rows, spec, values = held
        at = places.xy[own]
        return np.concatenate([weights_of(spec, places, at[s], None, rows) @ values for s in blocks(len(at), 16 * m)])

    if m**2 <= 4 * BLOCK_PAIRS:
        return some(slice(0, m), (places, rows, spec, values))
    sc = spark.sparkContext
    held, size = sc.broadcast((places, rows, spec, values)), -(-m // sc.defaultParallelism)
    out = sc.parallelize([slice(lo, lo + size) for lo in range(0, m, size)], sc.defaultParallelism).map(lambda own: some(own, held.value)).collect()  # a few numbers a place
    held.destroy()
    return np.concatenate(out)


def foci(p: Points, df: DataFrame, t: str | None = None) -> DataFrame:
    cols = [F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    return df.select(*cols, *([F.col(t).cast("double").alias("t")] if t else [])).dropna()


def own_foci(df: DataFrame, p: Points) -> DataFrame:
    """The points themselves as foci, so that rows which ``points`` leaves out are none."""
    return df.sparkSession.range(len(p.fid)).withColumnRenamed("id", "i")


def local_fit(focus: DataFrame, p: Points, spec: Spec, extra: np.ndarray | None = None, t: str | None = None, noise: np.ndarray | None = None) -> DataFrame:
    """FIT rows for each focus; ``extra`` multiplies the points' weights, ``noise`` their variances. Foci are other places or ``own_foci``, which are met by place."""
    if focus.columns == ["i"] and len(p.fid):
        places, at = sites_of(p, extra, p.t is not None, noise)
        once = focus.sparkSession.range(len(places.fid)).withColumnRenamed("id", "i")
        return over_foci(once, (spec, places, at, p, extra), fit_sites, FIT, max(len(places.fid), int(at.rows.max())))
    return over_foci(focus if focus.columns == ["i"] else foci(p, focus, t), (spec, p, extra, noise), fit_block, FIT, len(p.fid))


#: How an adaptive probe becomes a whole number, for the first pair and for those after it.
FIRST_PROBE = {"upper": np.floor, "lower": np.round}
LATER_PROBE = {"upper": np.round, "lower": np.floor}
#: The search stops when the probes' distance from the bracket's ends, or the difference of their scores, is this small, or after so many steps.
STOP, MOST_STEPS = 1e-4, 100


def golden(score: Callable[[float], float], low: float, high: float, adaptive: bool, eps: float = STOP, most: int = MOST_STEPS) -> tuple[float, list[tuple[float, float]]]:
    """Golden-section minimum of a score over bandwidths and the trace of (bandwidth, score); adaptive bandwidths are whole numbers.

    A bracket holds two probes, each a golden share of its width from the far end. The end beyond the worse probe is
    given up, the better probe stays and a new one takes the other side.
    """
    share = 2 / (1 + math.sqrt(5))
    seen: dict[float, float] = {}

    def measured(b: float) -> float:
        if b not in seen:
            seen[b] = score(b)
        return seen[b]

    def probe(side: str, rounding: dict) -> float:
        b = low + reach if side == "upper" else high - reach
        return float(rounding[side](b)) if adaptive else b

    reach = share * (high - low)
    probes = {side: probe(side, FIRST_PROBE) for side in ("upper", "lower")}
    for step in range(most + 1):
        values = {side: measured(b) for side, b in probes.items()}
        better = "upper" if values["upper"] < values["lower"] else "lower"
        if step == most or abs(reach) <= eps or abs(values["upper"] - values["lower"]) <= eps:
            break
        reach *= share
        if better == "upper":
            low = probes["lower"]
            probes = {"lower": probes["upper"], "upper": probe("upper", LATER_PROBE)}
        else:
            high = probes["upper"]
            probes = {"upper": probes["lower"], "lower": probe("lower", LATER_PROBE)}
    return probes[better], list(seen.items())


def with_size(spec: Spec, size: float) -> Spec:
    return replace(spec, size=size)
