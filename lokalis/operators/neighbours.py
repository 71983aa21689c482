"""Nearest neighbours by a k-d partition: leaves of even numbers of points however the points are clustered.

Of the data at one place only the ``k`` smallest ids can be anyone's neighbours, and foci at one place have the same
ones; so places are met once, and a place that holds half of the rows is no larger than others. A bounded sample's
medians cut the plane into leaves. A focus first meets its own leaf, whose k-th distance bounds the search, and then
only the leaves that lie nearer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalis.operators.local import blocks
from lokalis.sources.store import written

#: Data places of a leaf, about, and sampled places for each leaf.
LEAF, SAMPLED = 2000, 40
#: Foci that visit one leaf in one group.
VISITORS = 20_000


@dataclass
class Tree:
    """Nodes in the order of their making: axis (-1: leaf), cut, children, box of the points that may lie there."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    box: np.ndarray

    def leaf_of(self, xy: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xy), np.int64)
        while (inner := self.axis[at] >= 0).any():
            i = np.flatnonzero(inner)
            node = at[i]
            below = xy[i, self.axis[node]] < self.cut[node]
            at[i] = np.where(below, self.low[node], self.high[node])
        return at

    def leaves_within(self, xy: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the focus, leaf) of all leaves whose box is not further than ``reach``."""
        i, node, found = np.arange(len(xy)), np.zeros(len(xy), np.int64), []
        while len(i):
            b = self.box[node]
            gap = np.maximum(0, np.maximum(b[:, :2] - xy[i], xy[i] - b[:, 2:]))
            near = np.hypot(gap[:, 0], gap[:, 1]) <= reach[i]
            i, node = i[near], node[near]
            leaf = self.axis[node] < 0
            found.append((i[leaf], node[leaf]))
            i, node = i[~leaf], node[~leaf]
            i, node = np.concatenate([i, i]), np.concatenate([self.low[node], self.high[node]])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def tree_of(sample: np.ndarray, leaves: int) -> Tree:
    """A k-d tree of about so many leaves from sampled places; a box ends at its cuts, outer ones are open."""
    nodes, todo = [], [(sample, np.array([-np.inf, -np.inf, np.inf, np.inf]), None)]
    least = max(1, len(sample) // max(1, leaves))
    while todo:
        own, box, parent = todo.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, box])
        if parent is not None:
            nodes[parent[0]][parent[1]] = me
        if len(own) < 2 * least:
            continue
        axis = int(np.ptp(own[:, 1]) > np.ptp(own[:, 0]))
        cut = float(np.median(own[:, axis]))
        if cut == own[:, axis].min():
            above = own[own[:, axis] > cut, axis]
            if not len(above):
                continue
            cut = float(above.min())
        nodes[me][:2] = axis, cut
        low, high = box.copy(), box.copy()
        low[2 + axis] = high[axis] = cut
        below = own[:, axis] < cut
        todo += [(own[~below], high, (me, 3)), (own[below], low, (me, 2))]
    columns = list(zip(*nodes))
    return Tree(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.stack(columns[4]))


def candidates(visits: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``x, y, d_fid, d``: the ``k`` nearest in its leaf of each visit. Crowded leaves' visitors are split, their data sent to each part."""
    crowds = visits.groupBy("leaf").agg(F.floor(F.count("*") / VISITORS).cast("int").alias("more"))
    left = visits.join(crowds, "leaf").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("more") + 1).cast("int"))
    right = data.join(crowds, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("more"))))
    right = right.select(F.col("leaf").alias("d_leaf"), F.col("part").alias("d_part"), F.col("x").alias("d_x"), F.col("y").alias("d_y"), "fid")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        fid, at = b.fid.to_numpy(np.int64), b[["d_x", "d_y"]].to_numpy(float)
        n = min(k, len(b))
        for s in blocks(len(a), max(1, len(b))) if n else ():
            own = a[["x", "y"]].to_numpy(float)[s]
            d = np.sqrt((own[:, None, 0] - at[None, :, 0]) ** 2 + (own[:, None, 1] - at[None, :, 1]) ** 2)
            i, j = np.nonzero(d <= np.partition(d, n - 1, 1)[:, n - 1 : n])
            order = np.lexsort((fid[j], d[i, j], i))
            i, j = i[order], j[order]
            on = np.arange(len(i)) - np.searchsorted(i, i) < n
            i, j = i[on], j[on]
            out.append(pd.DataFrame({"x": own[i, 0], "y": own[i, 1], "d_fid": fid[j], "d": d[i, j]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"x": [], "y": [], "d_fid": [], "d": []})

    return left.groupBy("leaf", "part").cogroup(right.groupBy("d_leaf", "d_part")).applyInPandas(run, "x double, y double, d_fid bigint, d double")


def nearest(focus: DataFrame, data: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """``fid, d_fid, rank, d``: the ``k`` nearest data rows of each focus by euclidean distance, ties by data id.

    Rows without coordinates are left out on both sides. Fewer than ``k`` data rows give as many ranks.
    """
    point = lambda df: df.select(F.col("fid").cast("long").alias("fid"), (F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y")).dropna()
    foci, rows = point(focus), point(data)
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("fid"))
    rows = written(rows.withColumn("__n", first).filter(F.col("__n") <= k).drop("__n"))
    spots = written(foci.groupBy("x", "y").agg(F.count("*").alias("many")))
    n = rows.count()
    leaves = max(1, n // leaf)
    wanted = leaves * SAMPLED
    sample = rows.select("x", "y").sample(min(1.0, 1.5 * wanted / max(n, 1)), seed=1).limit(2 * wanted).toPandas().to_numpy(float)
    tree = tree_of(sample if len(sample) else np.zeros((0, 2)), leaves)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=tree.leaf_of(pdf[["x", "y"]].to_numpy(float)))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xy = pdf[["x", "y"]].to_numpy(float)
            i, at = tree.leaves_within(xy, pdf.reach.to_numpy(float))
            on = at != tree.leaf_of(xy)[i]
            yield pd.DataFrame({"x": xy[i[on], 0], "y": xy[i[on], 1], "leaf": at[on]})

    held = written(rows.mapInPandas(placed, "fid bigint, x double, y double, leaf bigint"))
    own = written(candidates(spots.select("x", "y").mapInPandas(placed, "x double, y double, leaf bigint"), held, k))
    reach = spots.select("x", "y").join(own.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("d").alias("far")), ["x", "y"], "left")
    reach = reach.select("x", "y", F.when(F.col("n") >= min(k, n), F.col("far")).otherwise(F.lit(float("inf"))).alias("reach"))
    more = candidates(reach.mapInPandas(further, "x double, y double, leaf bigint"), held, k)
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("d", "d_fid"))
    best = own.unionByName(more).withColumn("rank", place).filter(F.col("rank") <= k)
    lists = best.groupBy("x", "y").agg(F.collect_list(F.struct("rank", "d_fid", "d")).alias("near"))
    # a place with very many foci is as many keys as it has thousands of them, 64 at most
    salted = lists.join(spots, ["x", "y"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.least(F.lit(63), F.col("many") / 1000).cast("int"))))
    many = salted.groupBy("x", "y").agg(F.max("salt").alias("most"))
    crowded = foci.join(F.broadcast(many.filter("most > 0")), ["x", "y"], "left") if spots.filter("many >= 1000").count() <= 100_000 else foci.join(many.filter("most > 0"), ["x", "y"], "left")
    dealt = crowded.withColumn("salt", F.pmod(F.xxhash64("fid"), F.coalesce("most", F.lit(0)) + 1).cast("int"))
    return dealt.join(salted, ["x", "y", "salt"]).select("fid", F.explode("near").alias("e")).select("fid", "e.d_fid", "e.rank", "e.d")
