"""Sums over the hat matrices of local models, block by block: no task and no driver holds a matrix of all points by all points.

The points, MOST_POINTS at most, are broadcast and hat rows are made anew from them wherever they are needed. So nothing is
shuffled but a row of sums for each block or point, and a task of a lost executor is just run again. Where many points share
a place, ``traces`` sums over pairs of places instead of points: the same sums, by what the points of a place add up to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lokalis.functions import kernels
from lokalis.operators.local import Points, Sites, Spec, blocks, distances, place_sums, sites_of, solve

#: Rows of a block of hat rows, and columns of what is made of it at once.
BLOCK, SLICE = 1024, 2048
#: Numbers that a task's columns of all back-fitted hat matrices hold.
MOST_HELD = 1 << 25
#: Pairs of points whose weights are made at once.
PAIRS_AT_ONCE = 4_000_000
#: Tasks that each give a row for every point.
MOST_ADDERS = 64
#: Numbers of the small matrices of a pair of blocks of places.
PAIR_NUMBERS = 1 << 22
#: By how much the weights of factors are off at most, how many factors are tried, and the least share of all squares that a place's weighted squares have where factors are used.
FACTORED, MOST_FACTORS, LEAST_SHARE = 1e-14, 1000, 1e-5


def reach(spec: Spec, p: Points, at: np.ndarray) -> np.ndarray:
    """The bandwidth of each of these points."""
    n = len(p.fid)
    if not spec.adaptive or not len(at):
        return np.full(len(at), float(spec.size))
    k, out = min(max(int(spec.size), 1), n) - 1, []
    for s in blocks(len(at), n):
        d = distances(spec, p.xy[at[s]], p.xy)
        out.append(np.partition(d, k, axis=1)[:, k] if spec.size <= n else d.max(1) * spec.size / n)
    return np.concatenate(out)


def weights(spec: Spec, p: Points, at: np.ndarray, band: np.ndarray, cols: slice) -> np.ndarray:
    """Kernel weights of points ``at`` against the points ``cols``."""
    return kernels.weights(spec.kernel, distances(spec, p.xy[at], p.xy[cols]), band[:, None] if spec.adaptive else spec.size)


def slices(n: int, width: int = SLICE) -> Iterator[slice]:
    for lo in range(0, n, width):
        yield slice(lo, min(n, lo + width))


def inverses(spec: Spec, p: Points, at: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The inverse of each point's weighted products of variables; NaN where it is singular."""
    c = p.X.shape[1]
    A = np.zeros((len(at), c, c))
    for cols in slices(len(p.fid)):
        A += np.einsum("mn,np,nq->mpq", weights(spec, p, at, band, cols), p.X[cols], p.X[cols], optimize=True)
    return solve(A, np.broadcast_to(np.eye(c), A.shape))[0]


def coefficient_rows(spec: Spec, p: Points, at: np.ndarray, band: np.ndarray, inv: np.ndarray, cols: slice) -> np.ndarray:
    """By what each response in ``cols`` enters each coefficient (first axis) of each point."""
    c = p.X.shape[1]
    half = (inv.reshape(-1, c) @ p.X[cols].T).reshape(len(at), c, -1)
    return (half * weights(spec, p, at, band, cols)[:, None, :]).transpose(1, 0, 2)


def summed(c) -> Column:
    """The sum; NaN where a task gave NaN, which comes back from pandas as null."""
    return F.when(F.count(c) == F.count("*"), F.sum(c)).otherwise(F.lit(math.nan))


def block_rows(n: int, cores: int) -> int:
    """Rows of a block: small tables still give each core some pairs of blocks."""
    return max(1, min(BLOCK, -(-n // math.ceil(2 * math.sqrt(2 * cores)))))


def column_means(spark: SparkSession, p: Points, spec: Spec) -> np.ndarray:
    """Of each coefficient (row) the mean, over all points, of each response's part in it: tasks sum their blocks and give a row for each point, which Spark adds up."""
    n, c = p.X.shape
    cores = spark.sparkContext.defaultParallelism
    size = block_rows(n, cores)
    held = spark.sparkContext.broadcast((p, spec))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, spec = held.value
        total = None
        for pdf in batches:
            for b in pdf.id:
                at = np.arange(b * size, min(n, (b + 1) * size))
                band = reach(spec, p, at)
                inv = inverses(spec, p, at, band)
                total = np.zeros((c, n)) if total is None else total
                for cols in slices(n):
                    total[:, cols] += coefficient_rows(spec, p, at, band, inv, cols).sum(1)
        if total is not None:
            yield pd.DataFrame({"k": np.arange(n), **{f"m{k}": v for k, v in enumerate(total)}})

    count = -(-n // size)
    rows = spark.range(0, count, 1, min(count, cores, MOST_ADDERS)).mapInPandas(run, "k bigint" + "".join(f", m{k} double" for k in range(c)))
    out = rows.groupBy("k").agg(*(summed(f"m{k}").alias(f"m{k}") for k in range(c))).toPandas().sort_values("k")
    held.destroy()
    return out.drop(columns="k").to_numpy(float).T / n


def traces(spark: SparkSession, p: Points, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Traces of ``M M'`` and of ``(M M')^2`` for ``M = I - S`` (first) and for each coefficient's matrix less its column means.

    Both are sums over pairs of row blocks: a block of ``M M'`` is the product of two blocks of rows, made slice by slice,
    and ``M M'`` is symmetric, so each pair is met once. One row of sums leaves each pair.
    """
    n, c = p.X.shape
    places, s = sites_of(p, None, False, None)
    if cheaper_by_places(len(s.rows), int(np.minimum(s.rows, c).sum()), n, c):
        return place_traces(spark, p, spec, places, s)
    cores = spark.sparkContext.defaultParallelism
    size = block_rows(n, cores)
    held = spark.sparkContext.broadcast((p, spec, column_means(spark, p, spec)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, spec, means = held.value

        def prepared(b: int) -> tuple:
            at = np.arange(b * size, min(n, (b + 1) * size))
            band = reach(spec, p, at)
            return at, band, inverses(spec, p, at, band)

        def rows(at: np.ndarray, band: np.ndarray, inv: np.ndarray, cols: slice) -> np.ndarray:
            C = coefficient_rows(spec, p, at, band, inv, cols)
            own = -np.einsum("mk,kmn->mn", p.X[at], C)
            here = np.flatnonzero((at >= cols.start) & (at < cols.stop))
            own[here, at[here] - cols.start] += 1
            return np.concatenate([own[None], C - means[:, None, cols]])

        for pdf in batches:
            for pair in pdf.id:
                j = (math.isqrt(8 * int(pair) + 1) - 1) // 2
                i = int(pair) - j * (j + 1) // 2
                a = prepared(i)
                b = a if i == j else prepared(j)
                G = np.zeros((1 + c, len(a[0]), len(b[0])))
                for cols in slices(n):
                    left = rows(*a, cols)
                    G += left @ (left if i == j else rows(*b, cols)).transpose(0, 2, 1)
                yield pd.DataFrame({"one": [np.trace(G, axis1=1, axis2=2) * (i == j)], "two": [(G * G).sum((1, 2)) * (1 if i == j else 2)]})

    count = -(-n // size)
    pairs = count * (count + 1) // 2
    sums = spark.range(0, pairs, 1, min(pairs, max(4 * cores, pairs // 8))).mapInPandas(run, "one array<double>, two array<double>")
    row = sums.agg(*(summed(F.col(t)[k]).alias(f"{t}{k}") for t in ("one", "two") for k in range(1 + c))).first()
    held.destroy()
    return np.array(row[: 1 + c], float), np.array(row[1 + c :], float)


def cheaper_by_places(count: int, rows: int, n: int, c: int) -> bool:
    """Whether the products over pairs of places (their points told by ``rows`` rows of variables) are fewer than those over pairs of points."""
    return count**2 * (c * (c + 1) // 2 * count + c * rows) < (1 + c) * n**3


def site_reach(spec: Spec, places: Points, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``reach`` of places that hold so many ``rows``."""
    if not spec.adaptive or not len(at):
        return np.full(len(at), float(spec.size))
    n, out = int(rows.sum()), []
    for s in blocks(len(at), len(rows)):
        d = distances(spec, places.xy[at[s]], places.xy)
        if spec.size > n:
            out.append(d.max(1) * spec.size / n)
            continue
        order = np.argsort(d, axis=1)
        last = (np.cumsum(rows[order], axis=1) >= max(int(spec.size), 1)).argmax(1)
        out.append(d[np.arange(len(d)), order[np.arange(len(d)), last]])
    return np.concatenate(out)


def place_columns(X: np.ndarray, s: Sites) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place's sums of products of variables, rows of variables with these products (the points themselves, or as many as variables where there are more), and these rows' places in order."""
    c, Z = X.shape[1], X[s.members]
    XX = np.add.reduceat(Z[:, :, None] * Z[:, None, :], s.first)
    few = np.repeat(s.rows <= c, s.rows)
    val, vec = np.linalg.eigh(XX[s.rows > c])  # more points than variables: as many rows with the same products
    L = np.concatenate([Z[few], (np.sqrt(np.maximum(val, 0))[:, :, None] * vec.transpose(0, 2, 1)).reshape(-1, c)])
    of = np.concatenate([np.repeat(np.arange(len(s.rows)), s.rows)[few], np.repeat(np.flatnonzero(s.rows > c), c)])
    order = np.argsort(of, kind="stable")
    return XX, L[order], of[order]


def place_traces(spark: SparkSession, p: Points, spec: Spec, places: Points, s: Sites) -> tuple[np.ndarray, np.ndarray]:
    """``traces`` over pairs of places. With A the inverses of places s and t, an element of ``M M'`` is that of the unit matrix less
    ``x'Bx``, where B = A_s w_st + w_ts A_t - A_s (sum of w_su w_tu XX_u) A_t is the same for all points of the two places; so their squares add up
    by the places' XX. Rows of a coefficient's matrix are those of their place. Variables are taken in an orthogonal basis, which leaves the hat matrix alone.
    """
    n, c = p.X.shape
    count = len(s.rows)
    R = np.linalg.qr(p.X, mode="r")
    base = np.linalg.inv(R) if np.isfinite(R).all() and np.linalg.cond(R) < 1e14 else np.eye(c)
    XX, L, of = place_columns(p.X @ base, s)
    cores = spark.sparkContext.defaultParallelism
    size = min(block_rows(count, cores), max(1, math.isqrt(PAIR_NUMBERS // c**2)))
    held = spark.sparkContext.broadcast((places, spec, s.rows, XX, L, of, base))

    def prepared(b: int, own) -> tuple:
        places, spec, rows, XX, _, _, base = own
        at = np.arange(b * size, min(count, (b + 1) * size))
        band = site_reach(spec, places, rows, at)
        A = np.zeros((len(at), c * c))
        for cols in slices(count):
            A += weights(spec, places, at, band, cols) @ XX[cols].reshape(-1, c * c)
        inv = solve(A.reshape(-1, c, c), np.broadcast_to(np.eye(c), (len(at), c, c)))[0]
        return at, band, inv, base @ inv

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = held.value, None
        for pdf in batches:
            for b in pdf.id:
                at, band, _, coefficients = prepared(b, own)
                total = np.zeros((c * c, count)) if total is None else total
                for cols in slices(count):
                    total[:, cols] += (coefficients * own[2][at][:, None, None]).reshape(-1, c * c).T @ weights(own[1], own[0], at, band, cols)
        if total is not None:
            yield pd.DataFrame({"k": np.arange(count), **{f"m{k}": v for k, v in enumerate(total)}})

    several = -(-count // size)
    rows = spark.range(0, several, 1, min(several, cores, MOST_ADDERS)).mapInPandas(add, "k bigint" + "".join(f", m{k} double" for k in range(c * c)))
    found = rows.groupBy("k").agg(*(summed(f"m{k}").alias(f"m{k}") for k in range(c * c))).toPandas().sort_values("k")
    means = spark.sparkContext.broadcast(found.drop(columns="k").to_numpy(float).reshape(count, c, c) / n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, V = held.value, means.value
        places, spec, rows, XX, L, of, _ = own
        for pdf in batches:
            for pair in pdf.id:
                j = (math.isqrt(8 * int(pair) + 1) - 1) // 2
                i = int(pair) - j * (j + 1) // 2
                a = prepared(i, own)
                b = a if i == j else prepared(j, own)
                (s_at, s_band, s_inv, s_row), (t_at, t_band, t_inv, t_row) = a, b
                Q = np.zeros((c, c, len(s_at), len(t_at)))
                G = np.zeros((c, len(s_at), len(t_at)))
                for cols in slices(count):
                    Ws = weights(spec, places, s_at, s_band, cols)
                    Wt = Ws if i == j else weights(spec, places, t_at, t_band, cols)
                    for u in range(c):
                        for v in range(u, c):
                            Q[u, v] += (Ws * XX[cols, u, v]) @ Wt.T
                    near = slice(np.searchsorted(of, cols.start), np.searchsorted(of, cols.stop))
                    at, X = of[near] - cols.start, L[near]
                    Us = Ws[:, at]
                    Ut = Us if i == j else Wt[:, at]
                    for k in range(c):
                        mean = (V[of[near], k] * X).sum(1)
                        left = Us * (s_row[:, k] @ X.T) - mean
                        G[k] += left @ (left if i == j else Ut * (t_row[:, k] @ X.T) - mean).T
                for u in range(c):
                    for v in range(u):
                        Q[u, v] = Q[v, u]
                here, there = slice(s_at[0], s_at[-1] + 1), slice(t_at[0], t_at[-1] + 1)
                st, ts = weights(spec, places, s_at, s_band, there), weights(spec, places, t_at, t_band, here).T
                B = st[:, :, None, None] * s_inv[:, None] + ts[:, :, None, None] * t_inv[None]
                B -= s_inv[:, None] @ Q.transpose(2, 3, 0, 1) @ t_inv[None]
                times = 1 if i == j else 2
                squares = np.einsum("stuv,suv->", B @ XX[t_at][None] @ B.swapaxes(2, 3), XX[s_at]) * times
                one, two = [0.0] * (1 + c), [squares, *(np.einsum("kst,s,t->k", G * G, rows[s_at].astype(float), rows[t_at].astype(float)) * times)]
                if i == j:
                    m = np.arange(len(s_at))
                    own_share = float((B[m, m] * XX[s_at]).sum())
                    one = [rows[s_at].sum() - own_share, *(G[:, m, m] @ rows[s_at])]
                    two[0] += rows[s_at].sum() - 2 * own_share
                yield pd.DataFrame({"one": [np.array(one, float)], "two": [np.array(two, float)]})

    pairs = several * (several + 1) // 2
    sums = spark.range(0, pairs, 1, min(pairs, max(4 * cores, pairs // 8))).mapInPandas(run, "one array<double>, two array<double>")
    row = sums.agg(*(summed(F.col(t)[k]).alias(f"{t}{k}") for t in ("one", "two") for k in range(1 + c))).first()
    held.destroy()
    means.destroy()
    return np.array(row[: 1 + c], float), np.array(row[1 + c :], float)


def factor(spec: Spec, places: Points) -> np.ndarray | None:
    """F with ``F F'`` the weights between places to FACTORED: a pivoted Cholesky decomposition, which needs few columns where the kernel is smooth. None where it needs many or the kernel is not known to be positive."""
    if spec.kernel != "gaussian" or spec.adaptive or spec.metric != "euclidean" or not spec.size > 0:
        return None
    m = len(places.fid)
    F_, left = np.empty((min(m // 2, MOST_FACTORS, MOST_HELD // m), m)), np.ones(m)
    for r in range(len(F_)):
        at = int(left.argmax())
        if left[at] <= FACTORED:  # no element is further off than the largest on the diagonal
            return np.ascontiguousarray(F_[:r].T)
        F_[r] = (kernels.weights(spec.kernel, distances(spec, places.xy[[at]], places.xy), spec.size)[0] - F_[:r, at] @ F_[:r]) / math.sqrt(left[at])
        left -= F_[r] ** 2
        left[at] = 0
    return None


def smoothed(spark: SparkSession, places: Points, rows: np.ndarray, squares: np.ndarray, k: int, spec: Spec, kept: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """``factor`` and each place's weighted ``squares`` of variable k; None where fits by them would not be as good as those by weights. ``kept`` has what was asked before."""
    if (k, spec) not in kept:
        once = next((v for (_, s), v in kept.items() if s == spec), None)
        F_ = once[0] if once else factor(spec, places)
        A = place_sums(spark, places, rows, spec, squares[:, None])[:, 0] if F_ is not None else np.zeros(1)
        kept[k, spec] = (F_, A) if A.min() > LEAST_SHARE * squares.sum() else None
    return kept[k, spec]


def backfitted(spark: SparkSession, p: Points, first: Spec, steps: list[tuple[int, Spec]]) -> tuple[float, float, np.ndarray]:
    """The hat matrices that back-fitting leaves after ``steps`` (variable and its bandwidth, in the order they were fitted), from a
    basic fit of ``first``: trace of their sum, its sum of squares, and for each point and variable the sum of squares of
    what the responses give to its coefficient.

    A column of the hat matrices depends on no other, so each task carries some columns of all of them through all steps. Coefficients
    are those of places, and what a response gives to them depends on its place and in proportion on its variables; so the columns are
    rows of variables that have the products of each place's points (``place_columns``), not more than places times variables.
    """
    n, c = p.X.shape
    places, s = sites_of(p, None, False, None)
    m, cores = len(s.rows), spark.sparkContext.defaultParallelism
    XX, L, of = place_columns(p.X, s)
    width = max(1, min(1024, MOST_HELD // (c * m), -(-len(of) // cores)))
    smooth: dict = {}
    for k, spec in steps:
        smoothed(spark, places, s.rows, XX[:, k, k], k, spec, smooth)
    held = spark.sparkContext.broadcast((places, first, steps, s.rows, XX, L, of, smooth))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, first, steps, rows, XX, L, of, smooth = held.value
        between: dict = {}
        at_once, every = max(64, PAIRS_AT_ONCE // m), np.arange(m)
        squares, s, ss = None, 0.0, 0.0
        bands = {spec: site_reach(spec, places, rows, every) for spec in {first, *(spec for _, spec in steps)} if spec.adaptive}

        def near(spec: Spec, at: slice) -> np.ndarray:
            return weights(spec, places, every[at], bands[spec][at] if spec.adaptive else np.zeros(0), slice(0, m))

        for pdf in batches:
            for b in pdf.id:
                own = slice(b * width, min(len(of), (b + 1) * width))
                there, X = of[own], L[own]
                C = np.empty((c, m, len(there)))
                for at in slices(m, at_once):
                    W = near(first, at)
                    A = (W @ XX.reshape(m, c * c)).reshape(-1, c, c)
                    C[:, at] = ((solve(A, np.broadcast_to(np.eye(c), A.shape))[0] @ X.T) * W[:, None, there]).transpose(1, 0, 2)
                short: list = [None] * c  # a variable's spec and the factors' part of its columns, which C lacks then

                def whole(j: int) -> None:
                    if short[j]:
                        F_, A = smooth[j, short[j][0]]
                        C[j] = (F_ @ short[j][1]) / A[:, None]
                        short[j] = None

                for k, spec in steps:
                    others = [j for j in range(c) if j != k]
                    if smooth[k, spec]:
                        F_ = smooth[k, spec][0]
                        Y = F_[there].T * X[:, k]
                        for j in others:
                            if short[j]:
                                key = k, spec, j, short[j][0]
                                if key not in between:
                                    G, A = smooth[j, short[j][0]]
                                    between[key] = (F_ * (XX[:, k, j] / A)[:, None]).T @ G
                                Y -= between[key] @ short[j][1]
                            else:
                                Y -= F_.T @ (XX[:, k, j, None] * C[j])
                        short[k] = spec, Y
                        continue
                    for j in others:
                        whole(j)
                    short[k], rest = None, -sum((XX[:, k, j, None] * C[j] for j in others), np.zeros(C.shape[1:]))
                    rest[there, np.arange(len(there))] += X[:, k]
                    for at in slices(m, at_once):
                        W = near(spec, at)
                        with np.errstate(all="ignore"):
                            C[k, at] = (W @ rest) / (W @ XX[:, k, k])[:, None]
                for j in range(c):
                    whole(j)
                s += float(np.einsum("rk,kr->", X, C[:, there, np.arange(len(there))]))
                ss += sum(float((XX[:, j, k] * np.einsum("mr,mr->m", C[j], C[k])).sum()) for j in range(c) for k in range(c))
                part = np.einsum("kmr,kmr->mk", C, C)
                squares = part if squares is None else squares + part
        if squares is not None:
            first_only = every == 0
            yield pd.DataFrame({"k": every, "s": s * first_only, "ss": ss * first_only, **{f"q{k}": v for k, v in enumerate(squares.T)}})

    count = -(-len(of) // width)
    rows = spark.range(0, count, 1, min(count, max(cores, count // 8))).mapInPandas(run, "k bigint, s double, ss double" + "".join(f", q{k} double" for k in range(c)))
    out = rows.groupBy("k").agg(*(F.sum(v).alias(v) for v in ("s", "ss", *(f"q{k}" for k in range(c))))).toPandas().sort_values("k")
    held.destroy()
    squares = np.empty((n, c))
    squares[s.members] = np.repeat(out[[f"q{k}" for k in range(c)]].to_numpy(float), s.rows, axis=0)
    squares[p.X == 0] = np.nan  # a variable that is nought there has no share in the fit to tell its error by
    return float(out.s.sum()), float(out.ss.sum()), squares
