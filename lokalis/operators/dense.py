"""Local summaries in numpy blocks: foci are dealt over tasks, the data points are broadcast behind a count.

Rows of one place are met as one (``sites``): foci there share their result, and for means the data there enter with
their number and sums. A task holds a block of foci against all points at a time. For compact kernels of a fixed bandwidth the points are
sorted by x and a block sees only the strip that its foci reach. Tables of more than ``pairs.BROADCAST_POINTS``
points go through the grid join of ``pairs`` where the kernel has an edge, else through ``tiles``; these shuffle and
give the same rows. Rows with a null among coordinates or variables are left out of the data; foci without
coordinates give no rows; a focus on which no data row has weight has one row of nulls, in every plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalis.functions import distance as dist
from lokalis.functions import kernels
from lokalis.operators import neighbours, pairs, sites, summary, tiles
from lokalis.operators.local import Points, Spec, blocks, distances, over_foci, weigh
from lokalis.operators.rows import numbered

#: Pairs of a strip: few enough to stay in a core's cache.
STRIP_PAIRS = 200_000


def small(data: DataFrame) -> bool:
    return data.count() <= pairs.BROADCAST_POINTS


def held(data: DataFrame, names: list[str]) -> Points:
    """The data sorted by x; ``X`` has the variables in order."""
    pdf = data.select(F.col("fid").cast("long").alias("fid"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(["x", "y", *names]))).dropna().toPandas()
    pdf = pdf.sort_values(["v0", "fid"], kind="stable")
    v = pdf.drop(columns="fid").to_numpy(float)
    return Points(pdf.fid.to_numpy(np.int64), v[:, :2], v[:, 2:], np.zeros(len(v)))


def places(focus: DataFrame) -> DataFrame:
    return focus.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()


def strips(pdf: pd.DataFrame, p: Points, spec: Spec, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(foci's ids, points' slice, weights) of blocks of foci in the order of x; ``rows`` of ``weigh``."""
    pdf = pdf.sort_values("x", kind="stable")
    fid, xy = pdf.fid.to_numpy(np.int64), pdf[["x", "y"]].to_numpy(float)
    compact = not spec.adaptive and spec.kernel in kernels.COMPACT and spec.metric in ("euclidean", "manhattan", "chebyshev") and not spec.theta
    step = max(1, (8 if compact else 1) * STRIP_PAIRS // max(1, len(p.fid)))
    for s in (slice(lo, min(lo + step, len(fid))) for lo in range(0, len(fid), step)):
        near = slice(np.searchsorted(p.xy[:, 0], xy[s, 0].min() - spec.size), np.searchsorted(p.xy[:, 0], xy[s, 0].max() + spec.size, "right")) if compact else slice(0, len(p.fid))
        reach = distances(spec, xy[s], p.xy[near])
        yield fid[s], near, weigh(spec, reach, rows) if reach.shape[1] else reach


def metric_of(spec: Spec) -> dist.Distance:
    known = {"euclidean": dist.euclidean, "geographic": dist.great_circle, "chebyshev": dist.by_power(1), "manhattan": dist.by_power(-1)}
    own = known[spec.metric] if spec.metric in known else dist.minkowski(float(spec.metric))
    return dist.turned(own, spec.theta) if spec.theta and spec.metric not in ("euclidean", "geographic") else own


def near_only(spec: Spec) -> bool:
    """Whether a grid join finds all pairs with weight."""
    return not spec.adaptive and spec.kernel in kernels.COMPACT and spec.metric == "euclidean" and spec.size > 0


def weighted(focus: DataFrame, data: DataFrame, spec: Spec) -> DataFrame:
    """The pair plan of the same weights."""
    return pairs.weighted(focus.select("fid", "x", "y"), data, pairs.Bandwidth(spec.size, spec.kernel, spec.adaptive, metric_of(spec)))


def whole(data: DataFrame, names: list[str]) -> DataFrame:
    """The rows that ``held`` keeps, for the plans that shuffle."""
    return data.select(F.col("fid").cast("long").alias("fid"), *(F.col(f"`{c}`").cast("double").alias(c) for c in ["x", "y", *names])).dropna()


def every(focus: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each focus with coordinates."""
    return places(focus).select("fid").join(rows, "fid", "left")


def at_places(focus: DataFrame, found) -> DataFrame:
    """``found`` of the foci's places (with ids of their own) as rows of the foci."""
    own = places(focus)
    once = sites.of(own)
    return sites.back(once, found(once), own, how="inner")


def means(focus: DataFrame, data: DataFrame, names: list[str], spec: Spec) -> DataFrame:
    """``fid`` and the local weighted mean of each variable (``<name>_LM``); null where all weights are 0."""
    terms = {"n": F.count("*").cast("double"), **{f"s{k}": F.sum(f"`{v}`") for k, v in enumerate(names)}}
    known = sites.of(whole(data, names), terms)
    if not small(known):
        if not near_only(spec):
            return tiles.means(focus, data, names, spec)
        once = lambda own: every(own, weighted(own, known, spec).groupBy("fid").agg(*(F.try_divide(F.sum(F.col("w") * F.col(f"d_s{k}")), F.sum(F.col("w") * F.col("d_n"))).alias(f"{v}_LM") for k, v in enumerate(names))))
        return at_places(focus, once)

    def run(pdf: pd.DataFrame, p: Points) -> pd.DataFrame:
        out = []
        for fid, near, W in strips(pdf, p, spec, p.X[:, 0]):
            sums = W @ p.X[near]
            with np.errstate(all="ignore"):
                m = sums[:, 1:] / np.where(sums[:, 0] > 0, sums[:, 0], np.nan)[:, None]
            out.append(pd.DataFrame({"fid": fid, **{f"{v}_LM": m[:, k] for k, v in enumerate(names)}}))
        return pd.concat(out) if out else pd.DataFrame({"fid": [], **{f"{v}_LM": [] for v in names}})

    return at_places(focus, lambda own: over_foci(own, held(known, list(terms)), run, "fid bigint, " + ", ".join(f"`{v}_LM` double" for v in names), 1))


def quantiles(focus: DataFrame, data: DataFrame, name: str, spec: Spec) -> DataFrame:
    """Weighted local median, interquartile range and quantile imbalance: the value just before the cumulated weight exceeds the share."""
    if not small(data):
        return every(focus, summary.quantiles(weighted(places(focus), whole(data, [name]), spec), name)) if near_only(spec) else tiles.quantiles(focus, data, name, spec)

    def run(pdf: pd.DataFrame, p: Points) -> pd.DataFrame:
        out = []
        for fid, near, W in strips(pdf, p, spec):
            order = np.lexsort((p.fid[near], p.X[near, 0]))
            v, W = p.X[near, 0][order], W[:, order]
            total = np.cumsum(W, 1)
            none = ~(W > 0).any(1)
            if none.all():
                out.append(pd.DataFrame({"fid": fid, f"{name}_Median": np.nan, f"{name}_IQR": np.nan, f"{name}_QI": np.nan}))
                continue
            with np.errstate(all="ignore"):
                share = total / total[:, -1:]
            first = v[np.argmax(W > 0, 1)]
            q = []
            for k in (0.25, 0.5, 0.75):
                at = np.where((share <= k) & (W > 0), np.arange(len(v)), -1).max(1)
                q.append(np.where(none, np.nan, np.where(at >= 0, v[at], first)))
            with np.errstate(all="ignore"):
                iqr = q[2] - q[0]
                out.append(pd.DataFrame({"fid": fid, f"{name}_Median": q[1], f"{name}_IQR": iqr, f"{name}_QI": np.where(iqr != 0, (2 * q[1] - q[2] - q[0]) / iqr, np.nan)}))
        return pd.concat(out) if out else pd.DataFrame({"fid": [], f"{name}_Median": [], f"{name}_IQR": [], f"{name}_QI": []})

    rows = at_places(focus, lambda own: over_foci(own, held(data, [name]), run, f"fid bigint, `{name}_Median` double, `{name}_IQR` double, `{name}_QI` double", 1))
    return rows.select("fid", *(F.nanvl(F.col(f"`{name}_{k}`"), F.lit(None).cast("double")).alias(f"{name}_{k}") for k in ("Median", "IQR", "QI")))


def spearman(focus: DataFrame, data: DataFrame, x: str, y: str, spec: Spec) -> DataFrame:
    """Local rank correlation: ranks are places in the order of (value, id) among all data rows, ties not averaged; so a focus's value does not depend on other foci."""
    name = f"Spearman_rho_{x}.{y}"
    if not small(data):
        rows = whole(data, [x, y])
        ranks = numbered(numbered(rows, "rx", [x, "fid"]), "ry", [y, "fid"]).select("fid", "x", "y", F.col("rx").cast("double").alias("rx"), F.col("ry").cast("double").alias("ry"))
        found = summary.correlation(weighted(places(focus), ranks, spec), "rx", "ry") if near_only(spec) else tiles.correlation(focus, ranks, "rx", "ry", spec)
        return every(focus, found.select("fid", F.col("`Corr_rx.ry`").alias(name)))
    known = held(data, [x, y])
    known.X = np.column_stack([np.argsort(np.lexsort((known.fid, known.X[:, k]))).astype(float) for k in (0, 1)])

    def run(pdf: pd.DataFrame, p: Points) -> pd.DataFrame:
        out = []
        for fid, near, W in strips(pdf, p, spec):
            a, b = p.X[near, 0], p.X[near, 1]
            s = W.sum(1)
            with np.errstate(all="ignore"):
                ma, mb = W @ a / s, W @ b / s
                r = (W @ (a * b) / s - ma * mb) / np.sqrt((W @ (a * a) / s - ma * ma) * (W @ (b * b) / s - mb * mb))
            out.append(pd.DataFrame({"fid": fid, name: r}))
        return pd.concat(out) if out else pd.DataFrame({"fid": [], name: []})

    return at_places(focus, lambda own: over_foci(own, known, run, f"fid bigint, `{name}` double", 1))


def nearest(focus: DataFrame, data: DataFrame, k: int, spec: Spec = Spec(0)) -> DataFrame:
    """``fid, d_fid, rank, d``: the ``k`` nearest data rows of each focus, ties by data id; only candidates up to the k-th distance are sorted."""
    if not small(data):
        if spec.metric == "euclidean":
            return neighbours.nearest(focus, data, k)
        return pairs.nearest(places(focus), whole(data, []), k, metric_of(spec)).select("fid", "d_fid", "rank", "d")

    def run(pdf: pd.DataFrame, p: Points) -> pd.DataFrame:
        out = []
        for s in blocks(len(pdf), len(p.fid)):
            fid, d = pdf.fid.to_numpy(np.int64)[s], distances(spec, pdf[["x", "y"]].to_numpy(float)[s], p.xy)
            n = min(k, len(p.fid))
            if not n:
                continue
            i, j = np.nonzero(d <= np.partition(d, n - 1, 1)[:, n - 1 : n])
            order = np.lexsort((p.fid[j], d[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            on = rank <= n
            out.append(pd.DataFrame({"fid": fid[i[on]], "d_fid": p.fid[j[on]], "rank": rank[on], "d": d[i[on], j[on]]}))
        return pd.concat(out) if out else pd.DataFrame({"fid": [], "d_fid": [], "rank": [], "d": []})

    return at_places(focus, lambda own: over_foci(own, held(data, []), run, "fid bigint, d_fid bigint, rank int, d double", 1))


def correlations(focus: DataFrame, data: DataFrame, xs: list[str], ys: list[str], specs: dict[tuple[str, str], Spec] | Spec) -> DataFrame:
    """Local covariance and correlation of each x with each y, each pair by its own bandwidth: ``Cov_x.y`` and ``Corr_x.y``."""
    chosen = {(x, y): specs[x, y] if isinstance(specs, dict) else specs for x in xs for y in ys}
    if not small(data):
        out = places(focus).select("fid")
        for (x, y), s in chosen.items():
            found = summary.correlation(weighted(places(focus), whole(data, list(dict.fromkeys([x, y]))), s), x, y) if near_only(s) else tiles.correlation(focus, data, x, y, s)
            out = out.join(found, "fid", "left")
        return out
    names = list(dict.fromkeys([*xs, *ys]))
    columns = [f"{kind}_{x}.{y}" for x, y in chosen for kind in ("Cov", "Corr")]

    def run(pdf: pd.DataFrame, p: Points) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        out: dict[str, list] = {"fid": pdf.fid.to_numpy(np.int64), **{c: [] for c in columns}}
        for (x, y), spec in chosen.items():
            for _, near, W in strips(pdf, p, spec):
                a, b = p.X[near, names.index(x)], p.X[near, names.index(y)]
                with np.errstate(all="ignore"):
                    w = W / W.sum(1, keepdims=True)
                    scale = np.where(W.any(1), 1 - (w * w).sum(1), np.nan)  # a block of foci may have no point near it at all
                    cov = lambda u, v: (w @ (u * v) - (w @ u) * (w @ v)) / scale  # noqa: E731, B023
                    ab = cov(a, b)
                    out[f"Cov_{x}.{y}"].append(ab)
                    out[f"Corr_{x}.{y}"].append(ab / np.sqrt(cov(a, a) * cov(b, b)))
        return pd.DataFrame({k: np.concatenate(v) if isinstance(v, list) else v for k, v in out.items()}) if len(pdf) else pd.DataFrame({c: [] for c in out})

    return at_places(focus, lambda own: over_foci(own, held(data, names), run, "fid bigint, " + ", ".join(f"`{c}` double" for c in columns), len(xs) * len(ys)))
