"""Phrases whose words occur together more often than apart, by position bitmaps.

Texts are cut into shards of one language. In a shard each word has a bitmap of its positions; pieces are kept apart
by a position without a word. A phrase's bitmap has the positions of its last words: shifted by one and AND-ed with a
word's bitmap it becomes that of the phrase and the word, and its popcount is the phrase's count. Phrases are extended
depth-first, and the shards' popcounts are summed: each shard packs its phrases by hash into parts, Spark deals the
parts over its partitions, and a task adds up one part at a time. Bitmaps are compressed: those with a bit in 32 positions
or more are packed words of bits, of which a shard has few at each length; sparser ones are sorted arrays of positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, saved, slices, worker_memory

#: Words of a shard, about; a piece is never cut.
SHARD = 1_500_000
#: Words that are coded at once.
CODED = 50_000
#: A bitmap with a bit in so many positions is packed.
PACKED = 32
#: Sparse positions that are extended at once.
BLOCK = 200_000
#: What ends a piece, and the byte that stands for it (no text in UTF-8 has it).
ENDS, END = b".,;:!?\n\x0b\x0c\r", 0xFF
PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + bytes([END]) * len(ENDS) + b" ")
SCHEMA = "lang string, phrase string, f bigint"
PACKED_SCHEMA = "part int, lang string, packed binary"
#: Parts for each of Spark's shuffle partitions.
PARTS = 4


@dataclass
class Sparse:
    """Many phrases' bitmaps as positions: those of phrase ``owner[i]`` (any numbers, ascending) are ascending too."""

    owner: np.ndarray
    at: np.ndarray


def packed(at: np.ndarray, length: int) -> np.ndarray:
    bits = np.zeros(-(-length // 64) * 64, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def shifted(bits: np.ndarray) -> np.ndarray:
    """The bitmap moved on by one position."""
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


class Shard:
    """``word`` at each position: a number from 0, or -1 between pieces. ``found`` gives (words' numbers of each phrase, popcounts) by length."""

    def __init__(self, word: np.ndarray, words: int):
        self.word, self.length = word, len(word)
        order = np.argsort(word, kind="stable").astype(np.int32)
        order = order[np.searchsorted(word[order], 0) :]
        self.counts = np.bincount(word[order], minlength=words)
        dense = np.flatnonzero(self.counts * PACKED >= max(self.length, 1))
        self.is_dense = np.zeros(words, bool)
        self.is_dense[dense] = True
        start = np.concatenate([[0], np.cumsum(self.counts)])
        self.dense = {int(w): packed(order[start[w] : start[w + 1]], self.length) for w in dense}
        rest = order[~self.is_dense[word[order]]]
        self.sparse = Sparse(word[rest], rest)

    def extend(self, phrase: tuple[int, ...], bits: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Extensions of a packed phrase: with packed words by AND, with the sparse ones by the bits at their positions."""
        near = shifted(bits)
        for w, own in self.dense.items():
            both = near & own
            n = int(np.bitwise_count(both).sum())
            if not n:
                continue
            yield np.array([[*phrase, w]]), np.array([n])
            if depth > 1:
                if n * PACKED >= self.length:
                    yield from self.extend((*phrase, w), both, depth - 1)
                else:
                    at = unpacked(both)
                    yield from self.extend_sparse(np.array([[*phrase, w]]), Sparse(np.zeros(len(at), np.int64), at), depth - 1)
        at = self.sparse.at
        hit = (near[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        yield from self.grouped(np.array([phrase]), np.zeros(int(hit.sum()), np.int64), at[hit], depth)

    def extend_sparse(self, phrases: np.ndarray, bits: Sparse, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Extensions of sparse phrases: a shifted position has a bit in the bitmap of the one word that stands there."""
        for lo in range(0, len(bits.at), BLOCK):
            owner, at = bits.owner[lo : lo + BLOCK], bits.at[lo : lo + BLOCK] + 1
            inside = at < self.length
            owner, at = owner[inside], at[inside]
            on = self.word[at] >= 0
            yield from self.grouped(phrases, owner[on], at[on], depth)

    def grouped(self, phrases: np.ndarray, owner: np.ndarray, at: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Popcounts of what stands at positions behind phrases, and then what extends these. A phrase may come in several blocks."""
        if not len(at):
            return
        key = owner.astype(np.int64) * len(self.counts) + self.word[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        longer = np.column_stack([phrases[key[first] // len(self.counts)], key[first] % len(self.counts)])
        yield longer, n
        if depth > 1:
            yield from self.extend_sparse(longer, Sparse(np.repeat(np.arange(len(n)), n), at), depth - 1)

    def found(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words = np.flatnonzero(self.counts)
        yield words[:, None], self.counts[words]
        if longest > 1:
            for w, bits in self.dense.items():
                yield from self.extend((w,), bits, longest - 1)
            yield from self.extend_sparse(np.arange(len(self.counts))[:, None], self.sparse, longest - 1)


def words_of(text: bytes, most: int) -> Iterator[list[bytes]]:
    """Runs of a text's words, lower-cased in ASCII; END stands between pieces, and runs are cut there only."""
    plain, start = text.translate(PLAIN), 0
    while start < len(plain):
        end = plain.find(bytes([END]), start + most)
        end = len(plain) if end < 0 else end
        yield plain[start:end].replace(bytes([END]), bytes([32, END, 32])).split(b" ")
        start = end


class Words:
    """A shard's words as numbers, -1 between pieces."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.coded: list[np.ndarray] = []
        self.open: list[bytes] = []
        self.n = 0

    def add(self, words: list[bytes]) -> None:
        self.open += [w for w in words if w]
        self.open.append(bytes([END]))
        if len(self.open) >= CODED:
            self.code()

    def code(self) -> None:
        if self.open:
            part = pa.array(self.open, pa.binary()).dictionary_encode()
            own = [-1 if w[0] == END else self.known.setdefault(w, len(self.known)) for w in part.dictionary.to_pylist()]
            self.coded.append(np.array(own, np.int32)[part.indices.to_numpy()])
            self.n += len(self.open)
            self.open = []

    def parts(self, lang: str, longest: int, parts: int) -> Iterator[pa.RecordBatch]:
        """PACKED_SCHEMA rows of the shard, one for each part that has phrases; the empty phrase has the number of all words."""
        self.code()
        word = np.concatenate(self.coded or [np.zeros(0, np.int32)])
        strings = pa.array(list(self.known), pa.binary()).cast(pa.string())
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.known], np.uint64)
        self.known, self.coded = {}, []
        shard = Shard(word, len(strings))
        phrases, counts, keys = [pa.array([""])], [np.array([shard.counts.sum()])], [np.zeros(1, np.uint64)]
        by_length: dict[int, list] = {}
        for ids, n in shard.found(longest):
            by_length.setdefault(ids.shape[1], []).append((ids.astype(np.int32), n.astype(np.int64)))
        for found in by_length.values():
            ids, n = (np.concatenate(x) for x in zip(*found))
            found.clear()
            key = np.zeros(len(ids), np.uint64)
            for c in range(ids.shape[1]):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[ids[:, c]])
            words = [strings.take(pa.array(ids[:, c])) for c in range(ids.shape[1])]
            phrases.append(pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0])
            counts.append(n)
            keys.append(key)
        part = (np.concatenate(keys) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays(phrases).take(pa.array(order)), pa.array(np.concatenate(counts)[order])], ["phrase", "f"])
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
            yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + 1]), pa.array([lang]), pa.array([packed_rows(rows.slice(lo, hi - lo))], pa.binary())], ["part", "lang", "packed"])


def packed_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def summed_part(blobs: list[tuple[str, bytes]], least: int) -> Iterator[pa.RecordBatch]:
    """SCHEMA rows of a part's phrases with their counts over all shards, from ``least`` on; the empty phrase always."""
    tables: dict[str, list[pa.Table]] = {}
    for lang, blob in blobs:
        tables.setdefault(lang, []).append(pa.ipc.open_stream(blob).read_all())
    for lang, own in tables.items():
        sums = pa.concat_tables(own).group_by("phrase").aggregate([("f", "sum")])
        sums = sums.filter(pc.or_(pc.greater_equal(sums["f_sum"], least), pc.equal(sums["phrase"], "")))
        for batch in sums.to_batches(max_chunksize=CODED):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * batch.num_rows, pa.string()), batch.column("phrase"), batch.column("f_sum")], ["lang", "phrase", "f"])


def phrase_counts(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, phrase, f``: phrases of 1 to ``longest`` words, joined by blanks, that occur ``least`` times or more; the empty phrase has a language's number of words."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("collocations", lambda: None)
        shards: dict[str, Words] = {}
        done = lambda lang: shards.pop(lang).parts(lang, longest, partitions * PARTS)
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for part in words_of((text or "").encode(), 8 * CODED):
                    own = shards.setdefault(lang, Words())
                    own.add(part)
                    if own.n >= SHARD:
                        yield from done(lang)
            if sum(s.n + len(s.open) for s in shards.values()) >= 2 * SHARD:  # several languages: the largest in hand goes
                yield from done(max(shards, key=lambda k: shards[k].n + len(shards[k].open)))
        for lang in list(shards):
            yield from done(lang)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("collocations", lambda: None)
        now, blobs = None, []
        for batch in batches:
            for part, lang, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    yield from summed_part(blobs, least)
                    now, blobs = part, []
                blobs.append((lang, blob))
        yield from summed_part(blobs, least)

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(shards_of, PACKED_SCHEMA).repartition(partitions, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(sums_of, SCHEMA)


#: floor(1000000 a a / (l r)) in 38 digits: exact for counts below 10 to the 15th.
SCORE = "cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, best: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    Columns ``lang`` (null: und) and ``text`` (null: empty) are read, others ignored. A phrase of at least ``least``
    occurrences is a candidate; of its cuts into two parts the one with the lowest score counts, ties the earliest.
    Candidates that stand in a longer one with ``share`` percent of their occurrences or more are dropped. Empty
    tables and texts without words give no rows.
    """
    counts = phrase_counts(docs, longest, least)
    counts = saved(counts.withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))))
    words = F.split("phrase", " ", -1)
    part = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    phrases = counts.filter("k > 1")
    # a longer phrase that holds a phrase also holds one that is longer by a word, with no fewer occurrences
    inner = phrases.filter("k > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(part(1, F.col("k") - 1), part(2, F.col("k") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(0).alias("side"), part(1, F.col("cut")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))).alias("s")).select("lang", "phrase", "a", "cut", "s.*")
    known = counts.filter("k > 0").select("lang", F.col("phrase").alias("part"), "f")
    sided = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = sided.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = lowest.withColumn("rank", place.cast("long")).filter(F.col("rank") <= best)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
