"""Quality rules (operator 8): base counts and a hashed word and character n-gram logistic regression.

The model's features are the mean, over a text's words, of hashed words and of hashed character
n-grams of each padded word. It is trained on a bounded sample of labelled rows, calibrated on a part
of that sample it did not see, and its probability is held against a fixed threshold. As it is
linear in means over words, a worker keeps one number for each distinct word it has met.

Null and empty texts have no words: all counts are 0, ``base_failed`` is true and ``kept`` false.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, slices, texts, worker_memory
from .labelled import labelled_sample, platt

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SYMBOL = re.compile("[#*$%&|<>]+")
WINDOW = 8
#: Most labelled rows that the model is fitted on.
SAMPLE = 1_200
BITS = 18
GRAMS = (3, 4)
#: A text with a lower probability of being good is rejected.
GOOD = 0.5
REMEMBERED = 200_000
#: New words whose features are made at once.
LEARNT_AT_ONCE = 16_384

BASE = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
ODD = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more in the text; from 64-bit word hashes."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    w = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        w = (w + hashes[k : k + n]) * ODD
    w = mixed(w)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    covered = np.convolve(twice, np.ones(WINDOW, np.int64)) > 0
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += WORD.search(line) is not None
        else:
            seen.add(line)
    return n


def base_row(text: str, words: list[str], hashes: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    n = len(words)
    repeated = repeat_words(hashes)
    return n, sum(map(len, words)), sum(map(len, SYMBOL.findall(text))), dup_lines(text), repeated, n < 20 or 100 * repeated > 30 * n


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words as (place of the word, feature, share): the word with share 1, the character n-grams of the padded word with shares that add up to 1."""
    padded = [f"<{w}>" for w in words]
    half, n = 1 << BITS, len(words)
    a = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)  # a number for each character
    size = np.array([len(w) for w in padded], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(n), size)
    left = np.repeat(ends, size) - np.arange(len(a))  # characters from here to the word's end
    at, feature = [np.arange(n)], [np.array([zlib.crc32(w.encode()) % half for w in padded], np.int64)]
    for g in GRAMS:
        start = np.flatnonzero(left >= g)
        h = np.full(len(start), g, np.uint64)
        for i in range(g):
            h = h * ODD + a[start + i]
        at.append(owner[start])
        feature.append(half + (mixed(h) % np.uint64(half)).astype(np.int64))
    grams = np.bincount(np.concatenate(at[1:]), minlength=n)
    share = np.concatenate([np.ones(n), *(1 / grams[x] for x in at[1:])])
    return np.concatenate(at), np.concatenate(feature), share


class Vocabulary:
    """Numbers the words met, and keeps one 64-bit hash and one worth for each; starts anew when REMEMBERED are kept."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.number = weights, {}
        self.hashes, self.worth = np.zeros(0, np.uint64), np.zeros(0)

    def learn(self, words: set[str]) -> None:
        import xxhash

        if len(self.number) > REMEMBERED:
            self.__init__(self.weights)
        unknown = list(words.difference(self.number))
        for lo in range(0, len(unknown), LEARNT_AT_ONCE):
            new = unknown[lo : lo + LEARNT_AT_ONCE]
            at, feature, share = features(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.worth = np.append(self.worth, np.bincount(at, share * self.weights[feature], minlength=len(new)))
            self.hashes = np.append(self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in new), np.uint64, len(new)))


class QualityModel:
    """``weights`` over 2 * 2**BITS features, ``bias``, and the calibration's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset
        self.words = Vocabulary(self.weights)

    def read(self, words: list[list[str]]) -> list[np.ndarray]:
        """The words' numbers in the vocabulary, after all of them are learnt."""
        self.words.learn({w for ws in words for w in ws})
        return [np.fromiter(map(self.words.number.__getitem__, ws), np.int64, len(ws)) for ws in words]

    def probability(self, numbers: np.ndarray) -> float:
        raw = self.bias + (float(self.words.worth[numbers].mean()) if len(numbers) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30))))


def fit(examples: list[tuple[str, int]], steps: int = 80, rate: float = 0.5, ridge: float = 1e-7) -> QualityModel:
    """Fit on three quarters of the examples by full-batch Adam and calibrate on the rest. No examples: everything is good."""
    if not examples:
        return QualityModel(np.zeros(2 << BITS), 0.0, 0.0, 10.0)
    words = [WORD.findall(t) for t, _ in examples]
    names = sorted({w for ws in words for w in ws})
    number = {w: k for k, w in enumerate(names)}
    word_at, feature, share = features(names) if names else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(word_at, kind="stable")
    feature, share = feature[order], share[order]
    ends = np.cumsum(np.bincount(word_at, minlength=len(names)))
    rows, cols, vals = [], [], []
    for k, ws in enumerate(words):
        if not ws:
            continue
        own, n = np.unique(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), return_counts=True)
        size = ends[own] - np.where(own > 0, ends[own - 1], 0)
        at = np.repeat(ends[own] - np.cumsum(size), size) + np.arange(size.sum())
        total = np.bincount(feature[at], share[at] * np.repeat(n / len(ws), size))
        col = np.flatnonzero(total)
        rows.append(np.full(len(col), k, np.int32))
        cols.append(col.astype(np.int32))
        vals.append(total[col].astype(np.float32))
    row, col, val = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols, vals))
    y = np.array([label for _, label in examples], float)
    held = np.arange(len(y)) % 4 == 3
    scale = np.where(held, 0, 1 / np.where(y > 0, max(1, (y[~held] > 0).sum()), max(1, (y[~held] == 0).sum()))) / 2
    used, at = np.unique(col, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[at], minlength=len(y)) + b
        g = scale * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(at, val * g[row], minlength=len(used)) + ridge * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    z = np.bincount(row, val * w[at], minlength=len(y)) + b
    cal = held if held.any() and 0 < y[held].sum() < held.sum() else ~held
    slope, offset = platt(z[cal], y[cal], np.ones(cal.sum()))
    full = np.zeros(2 << BITS)
    full[used] = w
    return QualityModel(full, float(b), slope, offset)


def scored(docs: DataFrame, model: QualityModel, threshold: float = GOOD) -> DataFrame:
    """Base columns, ``probability`` and ``kept`` of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset))  # 2 MB, whatever the data
    key = repr((float(model.weights.sum()), model.bias, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = local_model(key, shared)
        for batch in slices(batches, most=1 << 20):
            out = []
            whole = texts(batch)
            words = [WORD.findall(t) for t in whole]
            for t, ws, numbers in zip(whole, words, own.read(words)):
                row = base_row(t, ws, own.words.hashes[numbers])
                p = own.probability(numbers)
                out.append((*row, p, not row[-1] and p >= threshold))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, f"{BASE}, probability double, kept boolean")


_local: dict[str, QualityModel] = {}


def local_model(key: str, shared) -> QualityModel:
    worker_memory("quality", _local.clear)
    if key not in _local:
        _local.clear()
        _local[key] = QualityModel(*shared.value)
    return _local[key]


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on a bounded sample of labelled rows and score every document."""
    return scored(docs, fit(labelled_sample(docs, labels, "quality", sample)))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = GOOD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rules and the model keep."""
    model = fit(labelled_sample(docs, labels, "quality", sample))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset))
    key = repr((float(model.weights.sum()), model.bias, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = local_model(key, shared)
        for batch in slices(batches, most=1 << 20):
            whole = texts(batch)
            words = [WORD.findall(t) for t in whole]
            verdict = [not base_row(t, ws, own.words.hashes[k])[-1] and own.probability(k) >= threshold for t, ws, k in zip(whole, words, own.read(words))]
            yield batch.filter(pa.array(verdict, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
