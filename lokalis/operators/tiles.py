"""Local models over tables of any size, by tiles of focus rows against data rows.

Rows of one place are met as one (``sites``): its foci share their sums, its data rows enter with theirs. Foci are
dealt to ``r`` groups and data rows to ``c`` groups by a hash; a tile is the meeting of one of each, so a
task holds at most some TILE rows a side whatever the table's size or the places of its rows. A tile gives each of
its foci sums over its data rows, which Spark adds up by focus. Nothing is broadcast, nothing but single rows of
sums reaches the driver. Results are those of the dense plans: where a focus has no weight its values are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalis.functions import kernels
from lokalis.operators import sites
from lokalis.operators.local import FIT, Spec, blocks, distances, solve
from lokalis.operators.rows import numbered
from lokalis.sources.store import dropped, exists, written

#: Rows of a tile's side, about.
TILE = 8192
#: Rows sent to a task, about: few tasks for small tables, whose tiles' work is in their pairs.
TASK_ROWS = 200_000
#: Parts into which each pass of a selection divides what is left.
PARTS = 256


def sides(focus: DataFrame, data: DataFrame, tile: int) -> tuple[int, int, int]:
    """Numbers of focus groups, data groups and tasks for their tiles; small tables still give each core a tile."""
    cores = focus.sparkSession.sparkContext.defaultParallelism
    n, m = focus.count(), data.count()
    c = max(1, -(-m // tile))
    r = max(1, -(-n // tile), min(-(-cores // c), n // 64))
    return r, c, min(r * c, max(4 * cores, (n * c + m * r) // TASK_ROWS))


def tiled(focus: DataFrame, data: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, tile: int = TILE, order: str | None = None) -> DataFrame:
    """``f`` of every tile; both tables have a ``fid``. Each row is sent to one group's tiles, r or c of them. With ``order``, a column of the numbers from 0, groups of data are runs of it."""
    r, c, tasks = sides(focus, data, tile)
    deal = lambda n: F.pmod(F.xxhash64(F.col("fid")), F.lit(n)).cast("int")
    left = focus.withColumn("r", deal(r)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    right = data.withColumn("c", F.least(F.floor(F.col(order) / tile), F.lit(c - 1)).cast("int") if order else deal(c)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    # columns of their own where both tables come from one
    right = right.select(*(F.col(x).alias(f"d_{x}") for x in right.columns))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns=lambda x: x.removeprefix("d_"))
        out = [x for x in f(a, b)] if len(a) and len(b) else []
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k.split()[0].strip("`"): [] for k in schema.split(", ")})

    return left.repartition(tasks, "r", "c").groupBy("r", "c").cogroup(right.repartition(tasks, "d_r", "d_c").groupBy("d_r", "d_c")).applyInPandas(run, schema)


def place_of(focus: DataFrame, data: DataFrame) -> tuple[str, ...]:
    """The columns that a distance is made of."""
    return (*sites.PLACE, "t") if "t" in focus.columns and "t" in data.columns else sites.PLACE


def state(df: DataFrame, y: str | None, xs: list[str], t: str | None = None, intercept: bool = True) -> DataFrame:
    """``fid, x, y, row`` (array, the intercept first), ``z`` (response), ``m`` (factor of the weight), ``v`` (variance) and perhaps ``t``; rows with a null among them are left out. Repeated ids are an error."""
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    own = [number(v).alias(f"v{k}") for k, v in enumerate(xs)]
    cols = [F.col("fid").cast("long").alias("fid"), number("x").alias("x"), number("y").alias("y"), (number(y) if y else F.lit(0.0)).alias("z"), *([number(t).alias("t")] if t else []), *own]
    rows = df.select(*cols).dropna()
    X = F.array(*([F.lit(1.0)] if intercept else []), *(F.col(f"v{k}") for k in range(len(xs))))
    out = rows.select("fid", "x", "y", "z", *(["t"] if t else []), X.alias("row"), F.lit(1.0).alias("m"), F.lit(1.0).alias("v"))
    if not out.groupBy("fid").count().filter("count > 1").isEmpty():
        raise ValueError("fid must be unique")
    return out


def weights(spec: Spec, a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Kernel weights of a block of foci, which have their own bandwidth ``b`` where it is adaptive, against data rows."""
    at, bt = (a.t.to_numpy(float), b.t.to_numpy(float)) if "t" in a and "t" in b else (None, None)
    d = distances(spec, a[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float), at, bt)
    w = kernels.weights(spec.kernel, d, a.b.to_numpy(float)[:, None] if spec.adaptive else spec.size)
    return np.where(bt[None, :] > at[:, None], 0.0, w) if at is not None and spec.future == "exclude" else w


def weighted_blocks(spec: Spec, a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for s in blocks(len(a), len(b)):
        yield a.iloc[s], weights(spec, a.iloc[s], b)


def all_distances(focus: DataFrame, data: DataFrame, spec: Spec, tile: int = TILE) -> DataFrame:
    """``focus_id, data_id, dist`` of every focus and data row, both with ``fid, x, y``; rows without a place are left out."""
    placed = lambda df: df.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for s in blocks(len(a), len(b)):
            own = a.iloc[s]
            d = distances(spec, own[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float))
            yield pd.DataFrame({"focus_id": np.repeat(own.fid.to_numpy(), len(b)), "data_id": np.tile(b.fid.to_numpy(), len(own)), "dist": d.ravel()})

    return tiled(placed(focus), placed(data), run, "focus_id bigint, data_id bigint, dist double", min(tile, 1024))


def kth_distance(focus: DataFrame, data: DataFrame, spec: Spec, tile: int = TILE) -> DataFrame:
    """``fid, b``: each focus's adaptive bandwidth, its distance to the ``size``-th nearest row; beyond the number n of rows, the largest times size / n.

    Passes over the tiles count each focus's distances in PARTS parts of the range that holds the one looked for;
    when it is narrow, its distances are counted by value. No focus's distances are gathered.
    """
    by = place_of(focus, data)
    foci, own = focus, data
    data = sites.of(own, {"n": F.count("*")}, by)
    times = sites.of(foci, by=by)
    n = data.agg(F.sum("n")).first()[0] or 0
    k = min(max(1, int(spec.size)), max(n, 1))

    def bounds(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for s in blocks(len(a), len(b)):
            d = measured(a.iloc[s], b)
            yield pd.DataFrame({"fid": a.fid.iloc[s].to_numpy(), "lo": d.min(1), "hi": d.max(1)})

    def measured(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        at, bt = (a.t.to_numpy(float), b.t.to_numpy(float)) if "t" in a and "t" in b else (None, None)
        return distances(spec, a[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float), at, bt)

    ends = tiled(times, data, bounds, "fid bigint, lo double, hi double", tile).groupBy("fid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if spec.size > n:
        return sites.back(times, ends.select("fid", (F.col("hi") * spec.size / n).alias("b")), foci, by, "inner")
    seen = written(ends.withColumn("before", F.lit(0).cast("long")))

    def counts(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for s in blocks(len(a), len(b)):
            lo, hi = (a[c].iloc[s].to_numpy()[:, None] for c in ("lo", "hi"))
            d = measured(a.iloc[s], b)
            i, j = np.nonzero((d >= lo) & (d <= hi))
            with np.errstate(all="ignore"):
                part = np.nan_to_num((d[i, j] - lo[i, 0]) / (hi[i, 0] - lo[i, 0]) * PARTS).astype(np.int64).clip(0, PARTS - 1)
            key, own, count = i * PARTS + part, d[i, j], b.n.to_numpy(np.int64)[j]
            order = np.argsort(key, kind="stable")
            key, own, count = key[order], own[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            low, high, count = (np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), np.add.reduceat(count, first)) if len(key) else (own, own, count)
            yield pd.DataFrame({"fid": a.fid.iloc[s].to_numpy()[key[first] // PARTS], "part": key[first] % PARTS, "n": count, "lo": low, "hi": high})

    for _ in range(3):
        parts = tiled(times.join(seen, "fid"), data, counts, "fid bigint, part bigint, n bigint, lo double, hi double", tile).groupBy("fid", "part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        up = Window.partitionBy("fid").orderBy("part")
        parts = parts.join(seen.select("fid", "before"), "fid").withColumn("upto", F.col("before") + F.sum("n").over(up)).filter(F.col("upto") >= k)
        at = parts.groupBy("fid").agg(F.min(F.struct("part", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"))).alias("p")).select("fid", "p.lo", "p.hi", "p.before")
        last, seen = seen, written(at)
        dropped(last)
        if seen.filter("hi > lo").isEmpty():
            return sites.back(times, seen.select("fid", F.col("lo").alias("b")), foci, by, "inner")

    def exact(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for s in blocks(len(a), len(b)):
            lo, hi = (a[c].iloc[s].to_numpy()[:, None] for c in ("lo", "hi"))
            d = measured(a.iloc[s], b)
            i, j = np.nonzero((d >= lo) & (d <= hi))
            yield pd.DataFrame({"fid": a.fid.iloc[s].to_numpy()[i], "d": d[i, j], "n": b.n.to_numpy(np.int64)[j]})

    each = tiled(times.join(seen, "fid"), data, exact, "fid bigint, d double, n bigint", tile).groupBy("fid", "d").agg(F.sum("n").alias("n"))
    each = each.join(seen.select("fid", "before"), "fid").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("fid").orderBy("d")))
    return sites.back(times, each.filter(F.col("upto") >= k).groupBy("fid").agg(F.min("d").alias("b")), foci, by, "inner")


def reached(focus: DataFrame, data: DataFrame, spec: Spec, tile: int = TILE) -> DataFrame:
    """Foci with the bandwidth ``b`` that ``weights`` needs."""
    return written(focus.drop("b").join(kth_distance(focus, data, spec, tile), "fid", "left")) if spec.adaptive else focus


def summed(focus: DataFrame, data: DataFrame, spec: Spec, terms: Callable[[pd.DataFrame], dict[str, np.ndarray]], tile: int = TILE, squares: Callable[[pd.DataFrame], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """``fid`` and, for each of the named ``terms`` of data rows, its sum by weight (for ``squares``, by squared weight)."""
    probe = data.limit(1).toPandas()
    names, square_names = list(terms(probe)), list(squares(probe)) if squares else []
    every, by = [*names, *square_names], place_of(focus, data)
    width = f", {', '.join(f'`{n}` double' for n in every)}"

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({c: b[c] for c in by} | terms(b) | (squares(b) if squares else {}))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        P, Q = b[names].to_numpy(float), b[square_names].to_numpy(float)
        for own, W in weighted_blocks(spec, a, b):
            out = dict(zip(names, (W @ P).T))
            if squares:
                out |= dict(zip(square_names, ((W * W) @ Q).T))
            yield pd.DataFrame({"fid": own.fid.to_numpy(), **out})

    known = data.mapInPandas(of_rows, ", ".join(f"{c} double" for c in by) + width)
    known = sites.of(known, {n: F.sum(F.coalesce(f"`{n}`", F.lit(math.nan))) for n in every}, by)
    foci = sites.of(focus, {"b": F.max("b")} if spec.adaptive else None, by)
    rows = tiled(foci, known, run, "fid bigint" + width, tile).groupBy("fid").agg(*(F.sum(f"`{n}`").alias(n) for n in every))
    return sites.back(foci, rows, focus, by)


def means(focus: DataFrame, data: DataFrame, names: list[str], spec: Spec, tile: int = TILE) -> DataFrame:
    """``fid`` and ``<name>_LM`` for each variable; null without weight."""
    rows = state(data, None, names, intercept=False)
    own = reached(focus.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), rows, spec, tile)
    terms = lambda b: {"s": np.ones(len(b)), **{f"s{k}": v for k, v in enumerate(stacked(b["row"], len(names)).T)}}
    sums = summed(own, rows, spec, terms, tile)
    return sums.select("fid", *(F.try_divide(F.col(f"s{k}"), F.col("s")).alias(f"{v}_LM") for k, v in enumerate(names)))


def correlation(focus: DataFrame, data: DataFrame, x: str, y: str, spec: Spec, tile: int = TILE) -> DataFrame:
    """``fid, Cov_x.y, Corr_x.y`` of ``summary.correlation``; null without weight."""
    rows = state(data, None, [x, y], intercept=False)
    own = reached(focus.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), rows, spec, tile)

    def terms(b: pd.DataFrame) -> dict[str, np.ndarray]:
        u, v = stacked(b["row"], 2).T
        return {"s": np.ones(len(b)), "sx": u, "sy": v, "xx": u * u, "yy": v * v, "xy": u * v}

    sums = summed(own, rows, spec, terms, tile, lambda b: {"ww": np.ones(len(b))})
    n = F.col("s")
    cov = lambda p, i, j: F.try_divide(F.try_divide(F.col(p), n) - F.try_divide(F.col(i) * F.col(j), n * n), 1 - F.try_divide(F.col("ww"), n * n))
    r = F.try_divide(cov("xy", "sx", "sy"), F.sqrt(cov("xx", "sx", "sx") * cov("yy", "sy", "sy")))
    return sums.select("fid", cov("xy", "sx", "sy").alias(f"Cov_{x}.{y}"), r.alias(f"Corr_{x}.{y}"))


def stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def local_fits(focus: DataFrame, data: DataFrame, spec: Spec, width: int, tile: int = TILE) -> DataFrame:
    """FIT rows of foci that are data rows (with ``row, z, m``) or other places (without): sums over tiles, then each focus's small system."""
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def terms(b: pd.DataFrame) -> dict[str, np.ndarray]:
        X, z, m = stacked(b["row"], width), b.z.to_numpy(float), b.m.to_numpy(float)
        return {f"a{i}_{j}": m * X[:, i] * X[:, j] for i, j in upper} | {f"r{i}": m * z * X[:, i] for i in range(width)}

    def squares(b: pd.DataFrame) -> dict[str, np.ndarray]:
        X, m, v = stacked(b["row"], width), b.m.to_numpy(float), b.v.to_numpy(float)
        return {f"c{i}_{j}": m * m * X[:, i] * X[:, j] for i, j in upper} | {f"n{i}_{j}": m * m * v * X[:, i] * X[:, j] for i, j in upper}

    sums = summed(focus, data, spec, terms, tile, squares)
    own = focus.select("fid", *(c for c in ("row", "z", "m") if c in focus.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            square = lambda c: np.stack([np.stack([pdf[f"{c}{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(width)], 1) for i in range(width)], 1)  # noqa: B023, E731
            A, B, N, b = square("a"), square("c"), square("n"), np.stack([pdf[f"r{i}"].to_numpy(float) for i in range(width)], 1)
            beta, ok = solve(A, np.nan_to_num(b))
            inv = np.linalg.inv(np.where(ok[:, None, None], A, np.eye(width)))
            C = inv @ np.nan_to_num(B) @ inv
            out = {"fid": pdf.fid, "beta": list(beta), "raw": list(np.einsum("mpp->mp", inv @ np.nan_to_num(N) @ inv)), "s_ii": np.nan, "ss": np.nan, "cv": np.nan, "ok": ok, "half": list(np.full((len(pdf), width), np.nan))}
            if "row" in pdf:
                x, z, w = stacked(pdf["row"], width), pdf.z.to_numpy(float), pdf.m.to_numpy(float)  # kernels weigh a distance of 0 by 1
                half = np.einsum("mpq,mq->mp", inv, x)
                loo, fine = solve(A - w[:, None, None] * x[:, :, None] * x[:, None, :], np.nan_to_num(b) - (w * z)[:, None] * x)
                out |= {"s_ii": w * (x * half).sum(1), "ss": np.einsum("mp,mpq,mq->m", x, C, x), "cv": np.where(fine, z - (x * loo).sum(1), np.inf), "half": list(half)}
            yield pd.DataFrame(out)

    return sums.join(own, "fid").mapInPandas(run, FIT + ", half array<double>")


HAT = "aggregate(zip_with(beta, row, (a, b) -> a * b), 0D, (s, e) -> s + e)"


def second_pass(fits: DataFrame, data: DataFrame, spec: Spec, mean: float, width: int, tile: int = TILE) -> DataFrame:
    """``fid, localR2, q``: what needs all fitted values (``yhat`` of data rows) and all foci's hat rows (of the same rows).

    q is a data row's sum of squares over the hat rows less the unit: a hat row is a weight times ``half`` of the
    focus times the data row, so the foci's products of ``half`` are added by place.
    """

    by, upper = place_of(fits, data), [(i, j) for i in range(width) for j in range(i, width)]
    place = (*by, "b") if spec.adaptive else by
    products = [f"h{i}_{j}" for i, j in upper]

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a in batches:
            if len(a):
                half, z, hat = stacked(a.half, width), a.z.to_numpy(float), a.yhat.to_numpy(float)
                half = np.where(np.isfinite(half).all(1)[:, None], half, 0.0)
                yield pd.DataFrame({c: a[c] for c in place} | {"tss": (z - mean) ** 2, "rss": (z - hat) ** 2} | {h: half[:, i] * half[:, j] for h, (i, j) in zip(products, upper)})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        errors, H = b[["tss", "rss"]].to_numpy(float), a[products].to_numpy(float)
        q, at = np.zeros((len(b), len(upper))), 0
        for own, W in weighted_blocks(spec, a, b):
            e = W @ errors
            q += (W * W).T @ H[at : at + len(own)]
            at += len(own)
            yield pd.DataFrame({"fid": own.fid.to_numpy(), "tss": e[:, 0], "rss": e[:, 1]} | dict.fromkeys(products, 0.0))
        yield pd.DataFrame({"fid": b.fid.to_numpy(), "tss": 0.0, "rss": 0.0} | dict(zip(products, q.T)))

    names = ["tss", "rss", *products]
    schema = ", ".join(f"{n} double" for n in names)
    known = data.mapInPandas(of_rows, ", ".join(f"{c} double" for c in place) + ", " + schema)
    known = sites.of(known, {n: F.sum(F.coalesce(n, F.lit(math.nan))) for n in names} | ({"b": F.max("b")} if spec.adaptive else {}), by)
    rows = tiled(known, known, run, "fid bigint, " + schema, tile).groupBy("fid").agg(*(F.sum(n).alias(n) for n in names))
    rows = sites.back(known, rows, data, by).join(data.select("fid", "row", "m", "half"), "fid")
    x, h = (lambda i: F.col("row")[i]), (lambda i: F.col("half")[i])
    total = lambda cs: reduce(lambda u, v: u + v, cs)
    of_all = F.pow("m", F.lit(2.0)) * total(F.col(p) * x(i) * x(j) * (1 if i == j else 2) for p, (i, j) in zip(products, upper))
    own = F.when(F.nanvl(total(h(i) for i in range(width)), F.lit(None).cast("double")).isNull(), 0.0).otherwise(1 - 2 * F.col("m") * total(h(i) * x(i) for i in range(width)))
    return rows.select("fid", F.try_divide(F.col("tss") - F.col("rss"), F.col("tss")).alias("localR2"), (of_all + own).alias("q"))


def basic(rows: DataFrame, names: list[str], spec: Spec, tile: int = TILE) -> tuple[DataFrame, dict]:
    """Basic regression of ``state`` rows: result columns and diagnostics of ``models.gwr``."""
    width = len(names)
    rows = reached(rows, rows, spec, tile)
    fits = written(local_fits(rows, rows, spec, width, tile).join(rows, "fid").withColumn("yhat", F.expr(HAT)))
    s = fits.agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.sum(F.pow(F.col("z") - F.col("yhat"), 2)).alias("rss"), F.sum("s_ii").alias("s"), F.sum("ss").alias("ss")).first()
    if not s["n"]:
        return result(fits.withColumn("localR2", F.lit(None).cast("double")).withColumn("q", F.lit(None).cast("double")), names, 1.0), {}
    tss = fits.agg(F.sum(F.pow(F.col("z") - F.lit(s["mean"]), 2))).first()[0]
    more = second_pass(fits.drop("beta", "raw", "s_ii", "ss", "cv", "ok"), fits, spec, s["mean"], width, tile)
    sigma2 = s["rss"] / (s["n"] - 2 * s["s"] + s["ss"])
    return result(fits.join(more, "fid"), names, sigma2), scores(s["n"], tss, s["rss"], s["s"], s["ss"]) | {"bandwidth": spec.size}


def result(rows: DataFrame, names: list[str], sigma2: float) -> DataFrame:
    se = lambda k: F.sqrt(F.lit(sigma2) * F.col("raw")[k])
    each = [F.col("beta")[k].alias(n) for k, n in enumerate(names)]
    residual = F.col("z") - F.col("yhat")
    return rows.select("fid", *each, F.col("z").alias("y"), "yhat", residual.alias("residual"), (residual / F.sqrt(F.lit(sigma2) * F.col("q"))).alias("Stud_residual"), *(se(k).alias(f"{n}_SE") for k, n in enumerate(names)), *((F.col("beta")[k] / se(k)).alias(f"{n}_TV") for k, n in enumerate(names)), "localR2")


def scores(n: int, tss: float, rss: float, s: float, ss: float) -> dict:
    enp = 2 * s - ss
    edf, r2 = n - enp, 1 - rss / tss if tss else math.nan
    base = n * math.log(rss / n) + n * math.log(2 * math.pi) if rss > 0 else -math.inf
    aicc = base + n * (n + s) / (n - 2 - s) if n - 2 - s > 0 and rss > 0 else math.inf
    return {"rss": rss, "aic": base + n + s, "aicc": aicc, "enp": enp, "edf": edf, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (edf - 1), "tr_s": s, "tr_sts": ss}


def robust(rows: DataFrame, names: list[str], spec: Spec, method: str, most: int, tol: float, tile: int = TILE) -> tuple[DataFrame, dict]:
    """Robust regression of ``state`` rows; each round's weights are a written table, and one row of sums tells when to stop."""
    if method == "filter":
        first, _ = basic(rows, names, spec, tile)
        keep = F.when(F.abs("Stud_residual") <= 3, 1.0).otherwise(0.0)
        again = written(rows.drop("m").join(first.select("fid", keep.alias("m")), "fid"))
        return basic(again, names, spec, tile)
    now, mse = written(reached(rows, rows, spec, tile)), None
    for _ in range(most + 1):
        fits = written(local_fits(now, now, spec, len(names), tile).join(now, "fid").select("fid", (F.col("z") - F.expr(HAT)).alias("e")))
        last, mse = mse, fits.agg(F.avg(F.col("e") * F.col("e"))).first()[0]
        if not mse or (last is not None and abs(last - mse) / mse <= tol):
            dropped(fits)
            break
        r = F.abs("e") / math.sqrt(mse)
        falling = F.when(r <= 2, 1.0).when(r < 3, F.pow(1 - F.pow(r - 2, 2), 2)).otherwise(0.0)
        if _ == most:
            dropped(fits)
            break
        following = written(now.drop("m").join(fits.select("fid", falling.alias("m")), "fid"))
        dropped(fits, now)
        now = following
    return basic(now, names, spec, tile)


def score(rows: DataFrame, names: list[str], spec: Spec, criterion: str = "CV", tile: int = TILE) -> float:
    """CV or AICc of a bandwidth; one row of sums reaches the driver."""
    rows = reached(rows, rows, spec, tile)
    fits = local_fits(rows, rows, spec, len(names), tile).join(rows.select("fid", "row", "z"), "fid")
    s = fits.agg(F.count("*").alias("n"), F.sum(F.col("cv") * F.col("cv")).alias("cv"), F.sum("s_ii").alias("s"), F.sum(F.pow(F.col("z") - F.expr(HAT), 2)).alias("rss")).first()
    if criterion == "CV":
        return float(s["cv"]) if s["cv"] is not None and math.isfinite(s["cv"]) else math.inf
    return scores(s["n"], 0.0, s["rss"], s["s"], 0.0)["aicc"] if s["n"] and s["rss"] and math.isfinite(s["rss"]) else math.inf


def log_counts(rows: DataFrame, y: str, family: str) -> DataFrame:
    """With ``lf``, the logarithm of y! that Poisson likelihoods need, else 0."""
    out = rows.withColumn("lf", F.lit(0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(lf=[math.lgamma(v + 1) for v in pdf[y]])

    return out.mapInPandas(run, out.schema) if family == "poisson" else out


def family_columns(family: str, y, nu) -> tuple:
    """(mu, working response, working weight) as columns; without ``nu`` the start values."""
    if family == "poisson":
        mu = y + 0.1 if nu is None else F.exp(nu)
        nu = F.log(mu) if nu is None else nu
        return mu, nu + (y - mu) / mu, mu
    mu = F.lit(0.5) if nu is None else 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), nu))))
    nu = F.lit(0.0) if nu is None else nu
    v = F.greatest(mu * (1 - mu), F.lit(2.2e-16))
    return mu, nu + (y - mu) / v, v


def likelihood_column(family: str, y, mu):
    tiny = lambda c: F.log(F.greatest(c, F.lit(1e-300)))
    return y * tiny(mu) - mu - F.col("lf") if family == "poisson" else y * tiny(mu) + (1 - y) * tiny(1 - mu)


def deviance_column(family: str, y, mu):
    if family == "poisson":
        return F.when(y != 0, 2 * (y * (F.log(y / mu) - 1) + mu)).otherwise(2 * mu)
    return -2 * F.log(F.greatest(F.abs(y - 1 + mu), F.lit(1e-300)))


def resumed(first: DataFrame, at: str | None) -> tuple[int, DataFrame]:
    """The last complete round below ``at`` and its number, or ``first`` written as round 0."""
    spark, k = first.sparkSession, -1
    while at and exists(spark, f"{at}/round-{k + 1}/_SUCCESS"):
        k += 1
    if k < 0:
        return 0, written(first, f"{at}/round-0" if at else None)
    out = spark.read.parquet(f"{at}/round-{k}")
    out.written_at = f"{at}/round-{k}"
    return k, out


def generalized(rows: DataFrame, names: list[str], spec: Spec, family: str, tol: float = 1e-5, most: int = 20, at: str | None = None, tile: int = TILE) -> tuple[DataFrame, dict]:
    """Local Poisson or binomial regression of ``state`` rows.

    The working response and weights of each round are a written table by fid, and the round's log-likelihood is the
    one number that reaches the driver. With a folder ``at`` the rounds stay there, and a call that was broken off
    is taken up behind the last complete one.
    """
    start = rows.withColumnRenamed("z", "yy")
    start = log_counts(start, "yy", family)
    y = F.col("yy")
    start = start.withColumn("z", family_columns(family, y, None)[1]).withColumn("last", F.lit(0.0))
    k, now = resumed(reached(start, start, spec, tile), at)
    while True:
        fits = local_fits(now, now, spec, len(names), tile).join(now.select("fid", "yy", "lf"), "fid")
        fits = written(fits.join(now.select("fid", "row"), "fid").withColumn("nu", F.expr(HAT)))
        mu, z, v = family_columns(family, y, F.col("nu"))
        ll = fits.agg(F.sum(likelihood_column(family, y, mu))).first()[0]
        before = now.agg(F.max("last")).first()[0]
        if ll is None or not math.isfinite(ll) or abs((before - ll) / ll) < tol or k + 1 >= most:
            break
        k += 1
        step = fits.select("fid", z.alias("z"), v.alias("m"), (1 / v).alias("v"), F.lit(ll).alias("last"))
        following = written(now.drop("z", "m", "v", "last").join(step, "fid"), f"{at}/round-{k}" if at else None)
        dropped(fits, *([] if at else [now]))
        now = following
    s = fits.agg(F.count("*").alias("n"), F.avg("yy").alias("mean"), F.sum("s_ii").alias("s"), F.sum("ss").alias("ss"), F.sum(deviance_column(family, y, mu)).alias("dev")).first()
    n, trace, dev = s["n"], s["s"] or 0.0, s["dev"] or 0.0
    null = fits.agg(F.sum(deviance_column(family, y, F.lit(s["mean"])))).first()[0]
    aic = dev + 2 * trace
    aicc = aic + 2 * trace * (trace + 1) / (n - trace - 1) if n - trace - 1 > 0 and math.isfinite(aic) else math.inf
    se = [F.sqrt(F.col("raw")[j]) for j in range(len(names))]
    out = fits.select("fid", *(F.col("beta")[j].alias(c) for j, c in enumerate(names)), F.col("yy").alias("y"), mu.alias("yhat"), (y - mu).alias("residual"), *(se[j].alias(f"{c}_SE") for j, c in enumerate(names)), *((F.col("beta")[j] / se[j]).alias(f"{c}_TV") for j, c in enumerate(names)))
    return out, {"log_likelihood": ll, "deviance": dev, "null_deviance": null, "pseudo_r2": 1 - dev / null if null else math.nan, "tr_s": trace, "tr_sts": s["ss"], "aic": aic, "aicc": aicc, "bandwidth": spec.size, "rounds": k + 1}


def quantiles(focus: DataFrame, data: DataFrame, name: str, spec: Spec, shares: tuple[float, ...] = (0.25, 0.5, 0.75), tile: int = TILE) -> DataFrame:
    """Median, interquartile range and imbalance of ``dense.quantiles`` by selection: no focus's pairs are sorted or gathered.

    Data rows get their place in the order of (value, id) once. Passes over the tiles sum each focus's weights in
    parts of the places that hold its share, until a part is one place: that where the cumulated weight first
    exceeds the share. The last place with weight before it has the value.
    """
    rows = numbered(state(data, None, [name], intercept=False).withColumn("value", F.col("row")[0]), "place", ["value", "fid"])
    rows = written(rows.withColumn("place", F.col("place") - 1))
    n = rows.count()
    focus = focus.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    own = written(reached(sites.of(focus), rows, spec, tile))
    asked = written(own.select("fid", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("share")) for k, s in enumerate(shares)))).alias("q")).select("fid", "q.*").withColumns({"lo": F.lit(0).cast("long"), "width": F.lit(n).cast("long"), "before": F.lit(0.0), "wanted": F.lit(None).cast("double")}))

    def per_part(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b.sort_values("place", kind="stable")
        place = b.place.to_numpy(np.int64)
        a = a[(a.lo <= place[-1]) & (a.lo + a.width > place[0])]  # data are runs of places: others have nothing to ask here
        for foci, W in weighted_blocks(spec, a, b):
            lo, width = (foci[c].to_numpy(np.int64) for c in ("lo", "width"))
            size = np.maximum(1, -(-width // PARTS))
            at = place[None, :] - lo[:, None]
            i, j = np.nonzero((at >= 0) & (at < width[:, None]) & (W > 0))
            sums = np.bincount(i * PARTS + at[i, j] // size[i], weights=W[i, j], minlength=len(foci) * PARTS)
            on = np.flatnonzero(sums > 0)
            yield pd.DataFrame({"fid": foci.fid.to_numpy()[on // PARTS], "k": foci.k.to_numpy()[on // PARTS], "part": on % PARTS, "w": sums[on]})

    while n and not asked.filter("width > 1").isEmpty():
        size = F.greatest(F.lit(1), F.ceil(F.col("width") / PARTS))
        parts = tiled(own.join(asked, "fid"), rows, per_part, "fid bigint, k int, part bigint, w double", tile, "place").groupBy("fid", "k", "part").agg(F.sum("w").alias("w"))
        each = Window.partitionBy("fid", "k")
        parts = parts.withColumn("upto", F.sum("w").over(each.orderBy("part"))).withColumn("total", F.sum("w").over(each))
        parts = parts.join(asked, ["fid", "k"]).withColumn("wanted", F.coalesce("wanted", F.col("share") * F.col("total")))
        over = parts.filter(F.col("before") + F.col("upto") > F.col("wanted")).groupBy("fid", "k").agg(F.min(F.struct("part", (F.col("before") + F.col("upto") - F.col("w")).alias("before"), "wanted")).alias("p"))
        step = asked.drop("before", "wanted").join(over, ["fid", "k"])
        lo = F.col("lo") + F.col("p.part") * size
        following = written(step.select("fid", "k", "share", lo.alias("lo"), F.least(size, F.col("lo") + F.col("width") - lo).alias("width"), F.col("p.before").alias("before"), F.col("p.wanted").alias("wanted")))
        dropped(asked)
        asked = following

    def last_before(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        place, value = b.place.to_numpy(np.int64), b.value.to_numpy(float)
        a = a[a.lo >= place.min()]
        for foci, W in weighted_blocks(spec, a, b):
            on = W > 0
            behind = place[None, :] < foci.lo.to_numpy(np.int64)[:, None]
            at = np.where(on & behind, place, -1)
            j = at.argmax(1)
            own_at = np.where(on & (place[None, :] == foci.lo.to_numpy(np.int64)[:, None]), 1, 0)
            here = own_at.argmax(1)
            i = np.arange(len(foci))
            yield pd.DataFrame({"fid": foci.fid.to_numpy(), "k": foci.k.to_numpy(), "at": at[i, j], "value": value[j], "own": np.where(own_at[i, here] > 0, value[here], np.nan)})

    found = tiled(own.join(asked, "fid"), rows, last_before, "fid bigint, k int, at bigint, value double, own double", tile, "place")
    found = found.groupBy("fid", "k").agg(F.max(F.when(F.col("at") >= 0, F.struct("at", "value"))).alias("v"), F.max(F.nanvl("own", F.lit(None).cast("double"))).alias("own"))
    found = found.select("fid", "k", F.coalesce("v.value", "own").alias("q"))
    wide = found.groupBy("fid").agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))))
    iqr = F.col("q2") - F.col("q0")
    return sites.back(own, wide, focus).select("fid", F.col("q1").alias(f"{name}_Median"), iqr.alias(f"{name}_IQR"), F.try_divide(2 * F.col("q1") - F.col("q2") - F.col("q0"), iqr).alias(f"{name}_QI"))
