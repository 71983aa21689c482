"""Token counts by offset-mapped attribution (operator 10).

A document is its fields, joined by a newline, and is encoded once. Its sections are the fields, or
the lines of the fields; a section ends with the newline that ends it. Token byte spans are
interval-joined to section spans: both are sorted, so one binary search finds each token's sections.

A token that crosses a boundary is allocated whole by ``rule``: ``first`` to the section of its
first byte, ``last`` to that of its last byte, ``most`` to the one that holds most of its bytes
(the earlier of equals). So the counts of a document's sections add up to its tokens.

A null field counts as empty; an empty document has one empty section without tokens. Repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ForcedBoundaryBpe, vocabulary
from .common import bounded_batches, slices

RULES = ("first", "last", "most")


def attributed(bpe: ForcedBoundaryBpe, encoded: bytes, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross a boundary; ``starts``: byte offsets, ascending."""
    ids = np.frombuffer(encoded, "<u4")
    end = np.cumsum(bpe.length[ids])
    begin = end - bpe.length[ids]
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    to = last if rule == "last" else first
    if rule == "most":
        to = first.copy()
        bounds = np.append(starts, size)
        for k in np.flatnonzero(last > first).tolist():
            held = [min(end[k], bounds[s + 1]) - max(begin[k], bounds[s]) for s in range(first[k], last[k] + 1)]
            to[k] = first[k] + int(np.argmax(held))
    return np.bincount(to, minlength=len(starts)), np.bincount(to[last > first], minlength=len(starts))


def token_counts(docs: DataFrame, path: str, fields: list[str] = ["text"], by_line: bool = True, rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """``id, section, field, start_byte, end_byte, n_tokens, n_crossing``: a row for each section of each document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    bounded_batches(docs.sparkSession)
    names = [f"f{k}" for k in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches, "size_of"):
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            columns = [batch.column(n).to_pylist() for n in names]
            rows = [[v or "" for v in values] for values in zip(*columns)]
            for row, (parts, encoded) in enumerate(zip(rows, bpe.encode_all(["\n".join(p) for p in rows]))):
                raw = "\n".join(parts).encode()
                ends = np.cumsum([len(p.encode()) + 1 for p in parts])
                starts = np.append(0, ends[:-1])
                if by_line:
                    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
                    starts = np.unique(np.concatenate([starts, at]))
                n, crossing = attributed(bpe, encoded, starts, len(raw), rule)
                for k, v in enumerate((np.full(len(starts), row), np.arange(len(starts)), np.searchsorted(ends, starts, "right"), starts, np.append(starts[1:], len(raw)), n, crossing)):
                    out[k].append(v)
            row, *rest = (np.concatenate(x).astype(np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *map(pa.array, rest)], ["id", "section", "field", "start_byte", "end_byte", "n_tokens", "n_crossing"])

    kept = docs.select(F.col(id_col).alias("id"), *(F.col(f).cast("string").alias(n) for f, n in zip(fields, names)))
    kept = kept.withColumn("size_of", F.concat(*(F.coalesce(n, F.lit("")) for n in names))) if len(names) > 1 else kept.withColumn("size_of", F.col(names[0]))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, section bigint, field bigint, start_byte bigint, end_byte bigint, n_tokens bigint, n_crossing bigint").withColumnRenamed("id", id_col)
