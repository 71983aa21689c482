"""Toxicity (operator 5): a convolutional text classifier trained in numpy.

Words (lower case, ``\\w+``) are hashed into an embedding table; filters of several widths run over the
whole text, each is max-pooled over all its positions and one logistic unit reads the pools. The network
is trained on a bounded sample of labelled rows, of which half at most is toxic. Its output becomes a
probability, at the labels' own rates, by a curve fitted to all labelled rows that it did not see. Language
never enters a score; it only picks the threshold of ``flagged``, told by the same rows of that language, all of them.

Null and empty texts are scored as texts without words. Repeated rows give equal rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, file_count, saved, slices, texts, worker_memory
from .labelled import labelled_rows, labelled_sample

WORD = re.compile(r"\w+")
BITS, DIM, FILTERS, WIDTHS = 16, 12, 8, (1, 2, 3)
#: Most labelled rows of each label that the network's training sees.
SAMPLE = 4_000
#: A score from this on is predicted toxic.
TOXIC = 0.3
#: The precision that the threshold of a language keeps on the calibration rows, where it can.
PRECISION = 0.9
REMEMBERED = 200_000


class WordIds(dict):
    """Word to embedding row (1 up; 0 pads)."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        k = zlib.crc32(word.encode()) % ((1 << BITS) - 1) + 1
        if len(word) <= 64:
            self[word] = k
        return k


def word_ids(text: str, known: WordIds) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def packed(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, each document followed by padding of the widest filter's reach, and the documents' starts."""
    gap = np.zeros(max(WIDTHS), np.int32)
    parts = [x for d in docs for x in (d, gap)]
    ids = np.concatenate(parts) if parts else gap
    starts = np.cumsum([0, *(len(d) + len(gap) for d in docs)])[:-1]
    return ids, starts


class TextCnn:
    """Parameters: ``E`` embeddings, ``W[width]`` filters (width, DIM, FILTERS), ``c`` filter offsets, ``u`` and ``b`` the output unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.E = r.normal(0, 0.3, (1 << BITS, DIM)).astype(np.float32)
        self.E[0] = 0
        self.W = {k: r.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.c = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.u = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.b = 0.0

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What each word adds to each filter at each of the filter's places."""
        return {k: [self.E @ self.W[k][i] for i in range(k)] for k in WIDTHS}

    def pooled(self, ids: np.ndarray, starts: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Largest value of each filter in each document, before the offset and the rectifier."""
        n = len(ids) - max(WIDTHS) + 1
        out = []
        for k in WIDTHS:
            a = tables[k][0][ids[:n]]
            for i in range(1, k):
                a = a + tables[k][i][ids[i : n + i]]
            out.append(np.maximum.reduceat(a, starts, axis=0))
        return np.concatenate(out, 1)

    def output(self, pools: np.ndarray) -> np.ndarray:
        return np.maximum(pools + self.c, 0) @ self.u + self.b

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 14, least_steps: int = 1500, batch: int = 32, rate: float = 0.004, drop: float = 0.3, seed: int = 11) -> None:
        """Adam on the logistic loss; words are dropped at random so that no single chance word is learnt."""
        r = np.random.default_rng(seed)
        state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        step = 0

        def adam(name: str, value: np.ndarray, g: np.ndarray, rows=None) -> None:
            m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            at = slice(None) if rows is None else rows
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-7)

        bias = np.array([self.b], np.float32)
        epochs = max(epochs, -(-least_steps * batch // max(1, len(docs))))
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for lo in range(0, len(order), batch):
                step += 1
                pick = order[lo : lo + batch]
                ids, starts = packed([docs[k] for k in pick])
                ids = np.where(r.random(len(ids)) < drop, 0, ids)
                X = self.E[ids]
                n = len(ids) - max(WIDTHS) + 1
                pools, best = [], []
                ends = np.append(starts[1:], n)
                for k in WIDTHS:
                    a = X[:n] @ self.W[k][0]
                    for i in range(1, k):
                        a += X[i : n + i] @ self.W[k][i]
                    arg = np.stack([s + a[s:e].argmax(0) for s, e in zip(starts, ends)])
                    best.append(arg)
                    pools.append(np.take_along_axis(a, arg, 0))
                P = np.concatenate(pools, 1) + self.c
                A = np.maximum(P, 0)
                z = A @ self.u + bias[0]
                dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
                dP = dz[:, None] * self.u * (P > 0)
                rows, grads = [], []
                dW = {}
                for j, k in enumerate(WIDTHS):
                    d, arg = dP[:, j * FILTERS : (j + 1) * FILTERS], best[j]
                    dW[k] = np.empty_like(self.W[k])
                    for i in range(k):
                        at = arg + i
                        dW[k][i] = np.einsum("bf,bfd->df", d, X[at])
                        rows.append(ids[at].ravel())
                        grads.append((d[:, :, None] * self.W[k][i].T[None]).reshape(-1, DIM))
                row, g = np.concatenate(rows), np.concatenate(grads)
                own, inv = np.unique(row, return_inverse=True)
                dE = np.zeros((len(own), DIM), np.float32)
                np.add.at(dE, inv, g)
                dE[own == 0] = 0
                adam("E", self.E, dE, own)
                for k in WIDTHS:
                    adam(f"W{k}", self.W[k], dW[k])
                adam("c", self.c, dP.sum(0))
                adam("u", self.u, A.T @ dz)
                adam("b", bias, np.array([dz.sum()], np.float32))
        self.b = float(bias[0])


class Outputs:
    """What a trained network makes of texts, before calibration."""

    def __init__(self, net: TextCnn):
        self.net, self.tables, self.known = net, net.tables(), WordIds()

    def of(self, batch: list[str]) -> np.ndarray:
        out = []
        for lo in range(0, len(batch), 64):
            ids, starts = packed([word_ids(t, self.known) for t in batch[lo : lo + 64]])
            out.append(self.net.output(self.net.pooled(ids, starts, self.tables)).astype(np.float64))
        return np.concatenate(out) if out else np.zeros(0)


def trained(examples: list[tuple[str, int]]) -> tuple[TextCnn, list[int]]:
    """A network trained on four fifths of the examples, and the places of these; none where they lack a label."""
    known = WordIds()
    docs, y = [word_ids(t, known) for t, _ in examples], np.array([l for _, l in examples], np.float32)
    net = TextCnn()
    if len(set(y.tolist())) < 2:
        return net, []
    own = np.random.default_rng(3).permutation(len(docs))[len(docs) // 5 :]
    net.train([docs[k] for k in own], y[own])
    return net, own.tolist()


def outputs(docs: DataFrame, net: TextCnn) -> DataFrame:
    """``doc_id, lang, z``: the network's output for every document; no language is an empty one."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net.E, net.W, net.c, net.u, net.b))  # 3 MB, whatever the data
    key = repr((float(net.E.sum()), net.b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = local_outputs(key, shared)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts(batch, "lang"), pa.string()), pa.array(own.of(texts(batch)))], ["doc_id", "lang", "z"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return kept.mapInArrow(run, "doc_id bigint, lang string, z double")


_local: dict[str, Outputs] = {}


def local_outputs(key: str, shared) -> Outputs:
    worker_memory("toxicity", _local.clear)
    if key not in _local:
        _local.clear()
        net = TextCnn()
        net.E, net.W, net.c, net.u, net.b = shared.value
        _local[key] = Outputs(net)
    return _local[key]


def probability(z: F.Column, slope: float, offset: float) -> F.Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z * slope + offset, F.lit(-30.0)), F.lit(30.0))))


def calibrated(rows: DataFrame, steps: int = 60) -> tuple[float, float]:
    """``labelled.platt`` of rows ``z, label, w`` by Spark: each Newton step is one row of sums."""
    n, spread = rows.agg(F.count("*"), F.stddev_pop("z")).first()
    scale = max(float(spread or 0), 1e-6)
    if not n:
        return 1.0, 0.0
    b = np.array([1.0, 0.0])
    x, w = F.col("z") / scale, F.col("w")
    for _ in range(steps):
        p = probability(x, float(b[0]), float(b[1]))
        miss, bend = w * (p - F.col("label")), w * p * (1 - p)
        g0, g1, h00, h01, h11 = rows.agg(F.sum(miss * x), F.sum(miss), F.sum(bend * x * x), F.sum(bend * x), F.sum(bend)).first()
        step = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + 1e-2 * np.eye(2), np.array([g0, g1]) + 1e-2 * b)
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def language_thresholds(rows: DataFrame, wanted: float = PRECISION, least: int = 20) -> DataFrame:
    """``lang, limit``: the smallest score from which on the precision of all of a language's rows ``lang, score, label, w`` is as wanted. No row where a language has fewer than ``least`` rows, or no such score.

    Equal scores are one; the rest is sorted by ranges of language and score, whose sums are carried on, so no language is one task.
    """
    cells = rows.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("w").alias("all"), F.sum(F.col("w") * F.col("label")).alias("toxic"))
    ranged = saved(cells.repartitionByRange("lang", F.desc("score")).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("lang", "part").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.sum("toxic").alias("toxic"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sums.select("lang", "part", F.sum("n").over(Window.partitionBy("lang")).alias("rows"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}_before") for c in ("all", "toxic")))
    within = Window.partitionBy("lang", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = ranged.join(F.broadcast(before), ["lang", "part"])
    share = (F.col("toxic_before") + F.sum("toxic").over(within)) / (F.col("all_before") + F.sum("all").over(within))
    return at.filter(F.col("rows") >= least).select("lang", "score", share.alias("share")).filter(F.col("share") >= wanted).groupBy("lang").agg(F.min("score").alias("limit"))


def held_out() -> F.Column:
    """Rows whose labels are never learnt: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = TOXIC) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged``: train and calibrate on labelled rows that are not held out, score every document. ``flagged`` uses the language's threshold (TOXIC for others)."""
    spark, allowed = docs.sparkSession, ~held_out()
    examples = labelled_sample(docs, labels, "toxic", sample, allowed, each=True, with_id=True)
    net, own = trained([(t, l) for t, l, _ in examples])
    seen = spark.createDataFrame([(examples[k][2],) for k in own], "doc_id long")  # bounded by ``sample``
    z = saved(outputs(docs, net), file_count(docs), spread=True)
    label = labelled_rows(labels, "toxic", allowed).groupBy("doc_id").agg(F.min("label").alias("label"))
    pairs = saved(z.groupBy("doc_id").agg(F.min(F.struct("lang", "z")).alias("own")).join(label, "doc_id").select("own.*", "label", "doc_id"), 8)
    counts = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count("*").alias("n")).collect()}
    unseen = pairs.join(F.broadcast(seen), "doc_id", "left_anti")
    left = {r["label"]: r["n"] for r in unseen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = {k: counts.get(k, 0) / max(1, left.get(k, 0)) for k in (0, 1)}  # what was not seen stands for all rows of its label
    rows = unseen.withColumn("w", F.when(F.col("label") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0])))
    if own:
        slope, offset = calibrated(rows)
    else:  # a label is missing: the score is the labels' rate
        share = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-4), 1 - 1e-4)
        slope, offset = 0.0, float(np.log(share / (1 - share)))
    score = probability(F.col("z"), slope, offset)
    limits = language_thresholds(rows.withColumn("score", score)) if own else spark.createDataFrame([], "lang string, limit double")
    out = z.join(F.broadcast(limits), "lang", "left").withColumn("score", score).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= F.coalesce("limit", F.lit(TOXIC))).alias("flagged"))
