"""Bounded samples of labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of all sampled texts together, at most: what the driver takes of very long ones.
MOST_CHARACTERS = 40_000_000


def labelled_rows(labels: DataFrame, label: str, allowed=None) -> DataFrame:
    """``doc_id, label``: the rows that have both, label 0 or 1, and meet the condition."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return rows if allowed is None else rows.filter(allowed)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed=None, each: bool = False, with_lang: bool = False, with_id: bool = False, most_characters: int = MOST_CHARACTERS) -> list[tuple]:
    """At most ``most`` whole texts with their 0/1 label (of each label, if ``each``), those with the smallest hash of the id, as long as they have ``most_characters`` together; with their language if ``with_lang``, with their id at the end if ``with_id``.

    ``allowed``: a condition on doc_id that sample rows meet. Rows with a null id or label are no examples; a null text counts as empty; of several texts or labels of an id the smallest is taken.
    """
    rows = labelled_rows(labels, label, allowed).groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    parts = [rows.filter(f"label = {k}") for k in (0, 1)] if each else [rows]
    keys = sorted((r["h"], r["doc_id"], r["label"]) for p in parts for r in p.orderBy("h", "doc_id").limit(most).collect())
    label_of = {k: v for _, k, v in keys}
    spark = docs.sparkSession
    named = ["text", "lang"] if with_lang else ["text"]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in named))

    def wanted(ids: list[int]) -> DataFrame:
        picked = spark.createDataFrame([(k,) for k in ids], "doc_id long")  # bounded by ``most``
        return text.join(F.broadcast(picked), "doc_id", "left_semi")

    size = {r["doc_id"]: r["n"] for r in wanted(list(label_of)).groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()}
    taken, total = [], 0
    for _, k, _ in keys:
        if k in size and total + size[k] <= most_characters:
            total += size[k]
            taken.append(k)
    found = wanted(taken).groupBy("doc_id").agg(F.min(F.struct(*named)).alias("own")).select("doc_id", "own.*").collect()
    return [(t, label_of[k], *rest, *([k] if with_id else [])) for k, t, *rest in sorted((r["doc_id"], *(r[c] for c in named)) for r in found)]


def platt(z, y, weight, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve from scores to weighted labels, by Newton steps with a small ridge."""
    import numpy as np

    scale = max(float(np.std(z)), 1e-6)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b - np.linalg.solve(h, g)
    return float(b[0] / scale), float(b[1])
