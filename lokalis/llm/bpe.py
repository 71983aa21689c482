"""BPE encoding and decoding by forced-boundary splitting (operator 7).

A byte pair that occurs inside no vocabulary token cannot be inside any token of an encoding, so
the place between its two bytes is a certain cut. Each pre-token is split at its certain cuts, the
fragments are encoded independently of each other and the ids are concatenated.

Null and empty texts give no ids. Repeated rows give equal rows. Columns besides the id and the
text are ignored by the query; their names may clash with anything.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts, worker_memory

#: How a byte-level vocabulary file spells bytes, and its pre-tokenizer's pattern.
#: Letters come first because no other alternative can match where they do.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
PRETOKEN = r" ?{L}+|'(?:s|t|re|ve|m|ll|d)| ?{N}+| ?[^{S}{L1}{N1}]+|{S}+(?!{X})|{S}+"
#: The classes for any text, and for texts with only the characters of LATIN, where Python's own re can be used.
ANY_TEXT = {"{L}": r"\p{L}", "{L1}": r"\p{L}", "{N}": r"\p{N}", "{N1}": r"\p{N}", "[^{S}": r"[^\p{White_Space}", "{S}": r"\p{White_Space}", "{X}": r"\P{White_Space}"}
LETTERS, SPACES = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\t-\r "
LATIN_TEXT = {"{L}": f"[{LETTERS}]", "{L1}": LETTERS, "{N}": "[0-9]", "{N1}": "0-9", "[^{S}": f"[^{SPACES}", "{S}": f"[{SPACES}]", "{X}": f"[^{SPACES}]"}
LATIN = re.compile("[\0-\x7f\u00c0-\u024f]*")

#: Distinct pre-tokens that a worker remembers before it starts anew; results don't depend on it.
REMEMBERED = 200_000
#: Longer pre-tokens are not remembered.
REMEMBERED_LENGTH = 64


def byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(rest)}


def pattern(classes: dict[str, str]) -> str:
    out = PRETOKEN
    for name, spelled in classes.items():
        out = out.replace(name, spelled)
    return out


class ForcedBoundaryBpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        spelled = {t: bytes(map(alphabet.__getitem__, t)) for t in vocab if all(c in alphabet for c in t)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        piece = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, b in spelled.items():
            piece[vocab[t]] = b
        for t, k in self.added.items():
            piece[k] = t.encode()
        self.length = np.array([len(b) for b in piece], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(piece), np.uint8)
        inside = np.zeros((256, 256), bool)
        for b in spelled.values():
            inside[list(b[:-1]), list(b[1:])] = True
        self.inside = inside
        self.spelling = {b: c for c, b in alphabet.items()}
        self.model = Tokenizer.from_file(path).model
        self.any_text, self.latin_text = regex.compile(pattern(ANY_TEXT)), re.compile(pattern(LATIN_TEXT))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return (self.latin_text if LATIN.fullmatch(text) else self.any_text).findall(text)

    def fragment(self, spelled: str) -> list[int]:
        """BPE of one fragment in the vocabulary's spelling of bytes."""
        return [t.id for t in self.model.tokenize(spelled)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, from those of its fragments: the words' bytes in a row, cut where a word ends and where no token goes on."""
        raw = [w.encode() for w in words]
        joined = b"".join(raw)
        a = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(b) for b in raw])
        cut = np.append(~self.inside[a[:-1], a[1:]], True)
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        until = np.searchsorted(stops, ends, "right").tolist()
        spelled, stops = joined.decode("latin-1").translate(self.spelling), stops.tolist()
        ids = [self.fragment(spelled[i:j]) for i, j in zip([0, *stops], stops)]
        size = np.cumsum([0, *map(len, ids)]).tolist()
        flat = np.array([k for f in ids for k in f], "<u4").tobytes()
        return {w: flat[4 * size[i] : 4 * size[j]] for w, i, j in zip(words, [0, *until], until)}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian 32-bit integers; added tokens are recognised."""
        parts: list[list[str]] = []
        of: list[list[int]] = []
        fixed: dict[int, bytes] = {}
        for text in texts:
            own = self.special.split(text) if self.special and any(t in text for t in self.added) else [text]
            of.append(list(range(len(parts), len(parts) + len(own))))
            for k, part in enumerate(own):
                if k % 2:
                    fixed[len(parts)] = np.array([self.added[part]], "<u4").tobytes()
                parts.append([] if k % 2 else self.words(part))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for p in parts for w in p}.difference(self.known))
        learnt = self.learn(new) if new else {}
        self.known.update((w, b) for w, b in learnt.items() if len(w) <= REMEMBERED_LENGTH)
        lookup = self.known if len(learnt) == 0 or max(map(len, new)) <= REMEMBERED_LENGTH else self.known | learnt
        return [b"".join(fixed[k] if k in fixed else b"".join(map(lookup.__getitem__, parts[k])) for k in ks) for ks in of]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes gathered from the vocabulary's, bad UTF-8 replaced."""
        n = self.length[ids]
        at = np.repeat(self.place[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, ForcedBoundaryBpe] = {}


def vocabulary(path: str) -> ForcedBoundaryBpe:
    """The vocabulary at ``path``, read once by each worker."""
    worker_memory("bpe", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<long>)`` of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in bpe.encode_all(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids array<bigint>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of rows with ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    kept = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: encoded, then decoded from its ids."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for raw in bpe.encode_all(texts(batch)):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
