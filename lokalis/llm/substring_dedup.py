"""Exact removal of repeated 200-byte strings by a distributed, common-prefix-aware suffix sort (operator 6).

A suffix is a text's bytes from some place on, cut at ``LENGTH`` bytes; those that start less than
``LENGTH`` bytes before their document's end take no part. Two equal suffixes are a repeat, and only the
merge of sorted suffixes tells them, by their bytes. Three sorts follow each other, with k-grams of
``GRAMS`` bytes; each sees what the one before left open:

1. *Anchors.* A suffix is named by the k-gram with the smallest hash inside it, so equal suffixes have equal
   anchors at equal places. Neighbours named by one anchor occurrence are a range: all of them are suffixes
   of one string, the range's text. In the last sort a range is a single suffix.
2. *Duplicate detection.* Anchors' hashes are exchanged; an anchor that occurs once has no repeat and its
   range is left out, so that only suffixes whose distinguishing prefix is longer than the k-gram are sorted.
   Tasks hand on at most two of each anchor, so a frequent passage is no hot key.
3. *Merge sort.* Tasks sort the ranges' texts, from the anchor on, into runs, front-code them (length of the prefix common
   with the predecessor, rest) and exchange the pieces of the runs by slices of the order. A loser tree
   merges a slice's pieces; it knows each candidate's common prefix with the last winner and compares
   only behind it. Neighbours that are equal as wholes are repeats. Neighbours that share the anchor but not
   the whole may share some suffixes: one of each text stays *open* for the next sort. What a run
   holds twice is told by the run itself and goes on once.

Each byte that a repeat covers is removed. Null texts count as empty; rows that repeat an id and text are
each other's repeats; rows with a null id are treated like others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, drop_shuffles, file_count, mixed, saved, slices, worker_memory

LENGTH = 200
#: k-gram lengths of the three sorts; the last must be LENGTH.
GRAMS = (64, 184, LENGTH)
#: Bytes that numpy works on at once, and ranges that a map task looks for doubles in at once.
BLOCK_BYTES, FLUSH_RANGES = 1 << 20, 250_000
#: Strings of one sorted run; strings for each slice of the order.
RUN, SLICE = 50_000, 40_000
#: Slices whose limits are chosen from a sample on the driver (at most), and strings sampled for each. Beyond them slices are cut by interpolation.
MOST_LIMITS, SAMPLE = 2_000, 16

#: The low bits of a hash that give way to its place in a block of BLOCK_BYTES and the longest overlap.
PLACE_BITS = np.uint64(21)
SENT, KNOWN, CANDIDATE = 0, 1, 2
COVERED, OPEN = 0, 1

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK_BYTES + 2 * LENGTH), base, np.uint64)
        p[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(p)
    return have[:n]


def packed(start: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A range in one word: its first suffix's start, the anchor's distance from it and the number of suffixes (both below 256)."""
    return (start.astype(np.int64) << 16) | (offset.astype(np.int64) << 8) | count.astype(np.int64)


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 16, (pos >> 8) & 255, pos & 255


def ranges(data: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the suffixes in pieces of ``data`` (at most 2**PLACE_BITS bytes) that end at ``ends``: anchor hash, start in ``data``, anchor's offset, count."""
    n, width = len(data), LENGTH - gram + 1
    if n < LENGTH:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(ODD, n), out=total[1:])
    h = mixed((total[gram:] - total[:-gram]) * powers(INVERSE, n)[: n - gram + 1])
    del total
    # the leftmost of the smallest; equal texts choose alike, wherever they stand
    low = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    del low
    room = np.repeat(ends, np.diff(np.append(0, ends)))[: len(anchor)] - np.arange(len(anchor))
    valid = room >= LENGTH
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return h[anchor[start]], start, anchor[start] - start, stop - start


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about BLOCK_BYTES with their pieces' ends, uid and first place in their unit. Longer units come in pieces whose suffixes don't overlap."""
    for batch in slices(batches, "body", BLOCK_BYTES // 2):
        body, uid = batch.column("body").to_pylist(), batch.column("uid").to_numpy()
        parts = [(b[lo : lo + BLOCK_BYTES // 2 + LENGTH - 1], u, lo) for b, u in zip(body, uid.tolist()) for lo in range(0, max(1, len(b) - LENGTH + 1), BLOCK_BYTES // 2)]
        held: list[tuple[bytes, int, int]] = []
        n = 0
        for k, part in enumerate(parts):
            held.append(part)
            n += len(part[0])
            if k + 1 == len(parts) or n + len(parts[k + 1][0]) > BLOCK_BYTES:
                data, u, lo = zip(*held)
                yield np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), np.array(u, np.int64), np.array(lo, np.int64)
                held, n = [], 0


def range_batch(key, kind, uid, pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int8()), pa.array(uid, pa.int64()), pa.array(pos, pa.int64())], ["key", "kind", "uid", "pos"])


def sent(key: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a map task hands on of its ranges: those whose anchor it has seen twice as candidates, their anchors once for others to know, the rest as they are."""
    order = np.argsort(key, kind="stable")
    key, uid, pos = key[order], uid[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    single = new & np.append(new[1:], True)
    home = mixed(uid.view(np.uint64)).view(np.int64)  # candidates only pass through the exchange
    for pick, kind, k in ((~single, CANDIDATE, home), (new & ~single, KNOWN, key), (single, SENT, key)):
        i = np.flatnonzero(pick)
        for a in range(0, len(i), 1 << 16):
            j = i[a : a + (1 << 16)]
            yield range_batch(k[j], np.full(len(j), kind), uid[j], pos[j])


def detecting(gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("suffixes", _powers.clear)
        held: list[tuple] = []
        n = 0
        for data, ends, uid, lo in blocks(batches):
            h, start, offset, count = ranges(data, ends, gram)
            piece = np.searchsorted(ends, start, "right")
            held.append((h.view(np.int64), uid[piece], packed(start - np.append(0, ends)[piece] + lo[piece], offset, count)))
            n += len(h)
            if n >= FLUSH_RANGES:
                yield from sent(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if held:
            yield from sent(*(np.concatenate(c) for c in zip(*held)))

    return run


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a partition sorted by ``key``: those sent as such, and the ranges of anchors that came twice. Of the last anchor of a batch, one range and whether it is known are held."""
    held: tuple | None = None  # (key, known, uid, pos); uid None: nothing left to tell
    for b in batches:
        key, kind, uid, pos = (b.column(c).to_numpy() for c in ("key", "kind", "uid", "pos"))
        passing = kind == CANDIDATE
        out = [(uid[passing], pos[passing])]
        key, kind, uid, pos = key[~passing], kind[~passing], uid[~passing], pos[~passing]
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            grp = np.cumsum(new) - 1
            many = (np.bincount(grp) > 1) | (np.bincount(grp, kind == KNOWN) > 0)
            if held is not None and held[0] == key[0]:
                many[0] = True
                if held[2] is not None:
                    out.append((np.array([held[2]], np.int64), np.array([held[3]], np.int64)))
            told = many[grp] & (kind == SENT)
            out.append((uid[told], pos[told]))
            held = (key[-1], True, None, None) if many[-1] else (key[-1], False, uid[-1], pos[-1])
        u, p = (np.concatenate(c) for c in zip(*out))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(p, pa.int64())], ["uid", "pos"])


def candidates(units: DataFrame, gram: int, files: int) -> DataFrame:
    """``uid, pos`` of the ranges whose anchor occurs more than once; written."""
    rows = units.select("uid", "body").mapInArrow(detecting(gram), "key bigint, kind tinyint, uid bigint, pos bigint")
    return saved(rows.repartition("key").sortWithinPartitions("key").mapInArrow(settled, "uid bigint, pos bigint"), files)


def strings(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int]]:
    """(text from the anchor on, then the text before it and its length; rid; range in the document) of a batch's candidates."""
    for rid, lo, body, at in zip(*(batch.column(c).to_pylist() for c in ("rid", "lo", "body", "at"))):
        for p in at:
            start, offset, count = p >> 16, (p >> 8) & 255, p & 255
            a = start + offset
            yield body[a : start + count - 1 + LENGTH] + body[start:a] + bytes((offset,)), rid, p + (lo << 16)


def range_text(s: bytes) -> bytes:
    """A range's text in its own order, of its string."""
    n = s[-1]
    return s[len(s) - 1 - n : -1] + s[: len(s) - 1 - n]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings whose first ``known`` bytes are equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_coded(run: list[tuple[bytes, int, int]]) -> tuple[bytes, bytes, int, bytes, bytes, bytes]:
    """A sorted piece: common prefix lengths with the predecessor (0 for the first), lengths, number of the rests' bytes, the rests compressed, rids, ranges."""
    lcp, tails, last = [], [], b""
    for s, _, _ in run:
        k = common(last, s, 0)
        lcp.append(k)
        tails.append(s[k:])
        last = s
    raw = b"".join(tails)
    numbers = (np.array([x[c] for x in run], np.int64).tobytes() for c in (1, 2))
    return np.array(lcp, np.uint16).tobytes(), np.array([len(s) for s, _, _ in run], np.uint16).tobytes(), len(raw), pa.compress(raw, "zstd", asbytes=True), *numbers


def decoded(lcp: bytes, size: bytes, n_raw: int, rests: bytes, rid: bytes, pos: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    tails = pa.decompress(rests, n_raw, "zstd", asbytes=True)
    last, at = b"", 0
    for k, n, r, p in zip(*(np.frombuffer(b, kind).tolist() for b, kind in ((lcp, np.uint16), (size, np.uint16), (rid, np.int64), (pos, np.int64)))):
        last = last[:k] + tails[at : at + n - k]
        at += n - k
        yield k, last, r, p


class LoserTree:
    """Merges sorted runs of (common prefix with the run's predecessor, string, rid, range).

    Every loser keeps the length of its common prefix with the one that beat it last. When two meet
    whose lengths differ, the longer one is smaller and nothing is compared; else they are compared behind it.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, int, int]]]):
        self.runs = runs
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.entry: list = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.lcp = [0] * self.k
        self.loser = [-1] * self.k
        self.winner = self.fill(1)

    def fill(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self.play(node, self.fill(2 * node), self.fill(2 * node + 1))

    def play(self, node: int, a: int, b: int) -> int:
        """The smaller of two players goes on; the other stays at the node."""
        x, y = self.entry[a], self.entry[b]
        if y is None or (x is not None and self.lcp[a] > self.lcp[b]):
            self.loser[node] = b
            return a
        if x is None or self.lcp[a] < self.lcp[b]:
            self.loser[node] = a
            return b
        s, t = x[1], y[1]
        n = common(s, t, self.lcp[a])
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            self.lcp[b] = n
            self.loser[node] = b
            return a
        self.lcp[a] = n
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        """(common prefix with the string before, string, rid, range) in order."""
        while (x := self.entry[self.winner]) is not None:
            w = self.winner
            yield self.lcp[w], *x[1:]
            self.entry[w] = nxt = next(self.runs[w], None)
            self.lcp[w] = nxt[0] if nxt else 0
            node = (w + self.k) // 2
            while node:
                w = self.play(node, w, self.loser[node])
                node //= 2
            self.winner = w


def told(merged: Iterator[tuple[int, bytes, int, int]], gram: int) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(COVERED, rid, range, None) of strings that equal a neighbour; (OPEN, rid, range, string) of one of each text among those that share an anchor.

    The anchors of the slice's first and last string may have others beyond it: their texts are open too.
    """
    last: tuple | None = None  # first of the running text: (string, rid, range)
    alone = telling = True  # is the running text a single string; are its anchor's texts open
    for lcp, s, rid, pos in merged:
        if last is not None and lcp == len(s) == len(last[0]):
            if alone:
                yield COVERED, last[1], last[2], None
            alone = False
            yield COVERED, rid, pos, None
            continue
        if last is not None:
            same = lcp >= gram
            if same or telling:
                yield OPEN, last[1], last[2], last[0]
            telling = same
        last, alone = (s, rid, pos), True
    if last is not None:
        yield OPEN, last[1], last[2], last[0]


def slice_limits(keys: list[bytes], n: int) -> list[bytes]:
    """At most ``n`` - 1 limits that cut the sorted sample in equal parts."""
    return sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []


def interpolated(s: bytes, lo: bytes, hi: bytes | None, n: int) -> int:
    """Which of ``n`` parts of the order between two limits a string is in, by the bytes behind the limits' common prefix."""
    k = 0 if hi is None else common(lo, hi, 0)
    at = lambda x: int.from_bytes(x[k : k + 8].ljust(8, b"\0"))
    low, high = at(lo), 1 << 64 if hi is None else at(hi) + 1
    return min(n - 1, max(0, at(s) - low) * n // (high - low))


PIECE = ["slice", "part", "lcp", "size", "n_raw", "rests", "rid", "pos"]
PIECE_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def pieces(run: list[tuple[bytes, int, int]], limits: list[bytes], parts: int) -> list[tuple]:
    """A run, sorted, cut by slices and parts of them and front-coded. Repeats inside are told at once, as a piece of slice -1, and go on once."""
    run.sort()
    doubled: list[tuple[int, int]] = []
    kept, telling = [], True
    for x in run:
        if kept and kept[-1][0] == x[0]:
            if telling:
                doubled.append(kept[-1][1:])
            doubled.append(x[1:])
            telling = False
        else:
            kept.append(x)
            telling = True
    out = []
    names = [x[0] for x in kept]
    cuts = [0, *(bisect_left(names, x) for x in limits), len(kept)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if parts == 1 or a == b:
            if a < b:
                out.append((k, 0, *front_coded(kept[a:b])))
            continue
        lo, hi = limits[k - 1] if k else b"", limits[k] if k < len(limits) else None
        which = [interpolated(s, lo, hi, parts) for s in names[a:b]]
        for part in sorted(set(which)):
            i, j = bisect_left(which, part), bisect_left(which, part + 1)
            out.append((k, part, *front_coded(kept[a + i : a + j])))
    if doubled:
        out.append((-1, 0, b"", b"", 0, b"", *(np.array(c, np.int64).tobytes() for c in zip(*doubled))))
    return out


#: An open range with its text, or many repeated ranges packed in one row, without rid and pos.
TOLD = "kind tinyint, rid bigint, pos bigint, text binary"


def told_batch(kind: list[int], rid: list, pos: list, text: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(rid, pa.int64()), pa.array(pos, pa.int64()), pa.array(text, pa.binary())], ["kind", "rid", "pos", "text"])


def covered_batch(rid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Repeated ranges as one row: ids and places in order, the places as steps from one to the next, compressed."""
    order = np.lexsort((pos, rid))
    raw = rid[order].tobytes() + np.diff(pos[order], prepend=0).tobytes()
    return told_batch([COVERED], [None], [None], [len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)])


def covered_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed_rows in batch.column("text").to_pylist():
            raw = np.frombuffer(pa.decompress(packed_rows[8:], int.from_bytes(packed_rows[:8], "little"), "zstd", asbytes=True), np.int64)
            n = len(raw) // 2
            yield pa.RecordBatch.from_arrays([pa.array(raw[:n]), pa.array(np.cumsum(raw[n:]))], ["rid", "pos"])


def suffix_sort(units: DataFrame, found: DataFrame, gram: int, files: int) -> DataFrame:
    """TOLD rows of the candidates ``found`` of ``units``, by runs, exchange and merge: repeats, and what stays open with its text; written."""
    total = found.count()
    n = max(1, min(MOST_LIMITS, -(-total // SLICE)))
    parts = max(1, -(-total // (SLICE * n)))
    limits: list[bytes] = []
    if n > 1:
        rate = min(1.0, SAMPLE * n / total)
        some = found.filter(F.xxhash64("uid", "pos") <= F.lit(int(rate * 2**64) - 2**63 - 1)).groupBy("uid").agg(F.collect_set("pos").alias("at"))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "body"):
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in strings(batch)], pa.binary())], ["key"])

        # about SAMPLE strings of some hundred bytes for each limit, 10 MB at most
        limits = slice_limits(sorted(bytes(r["key"]) for r in units.join(F.broadcast(some), "uid").mapInArrow(sample, "key binary").collect()), n)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("suffixes", _powers.clear)
        held: list[tuple[bytes, int, int]] = []
        for batch in slices(batches, "body"):
            for x in strings(batch):
                held.append(x)
                if len(held) >= RUN:
                    yield from flushed(held)
                    held = []
        if held:
            yield from flushed(held)

    def flushed(held: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        out = pieces(held, limits, parts)
        for a in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 64]), PIECE_KINDS)], PIECE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One slice after the other; only the pieces of one are held."""
        held: list[tuple] = []
        where = None
        for batch in batches:
            for *at, lcp, size, n_raw, rests, rid, pos in zip(*(batch.column(c).to_pylist() for c in PIECE)):
                if at[0] < 0:
                    yield covered_batch(np.frombuffer(rid, np.int64), np.frombuffer(pos, np.int64))
                    continue
                if held and at != where:
                    yield from merged(held)
                    held = []
                where = at
                held.append((lcp, size, n_raw, rests, rid, pos))
        if held:
            yield from merged(held)

    def merged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        covered: list[tuple[int, int]] = []
        opened: list[tuple] = []
        for kind, rid, pos, s in told(iter(LoserTree([decoded(*p) for p in held])), gram):
            if kind == COVERED:
                covered.append((rid, pos))
            elif gram < LENGTH:  # whole suffixes leave nothing open
                opened.append((OPEN, rid, pos, range_text(s)))
            if len(opened) >= 10_000:
                yield told_batch(*zip(*opened))
                opened = []
        if opened:
            yield told_batch(*zip(*opened))
        if covered:
            yield covered_batch(*(np.array(c, np.int64) for c in zip(*covered)))

    rows = units.join(found.groupBy("uid").agg(F.collect_set("pos").alias("at")), "uid")  # bounded by the unit's length
    cut = rows.mapInArrow(runs, "slice int, part bigint, lcp binary, size binary, n_raw bigint, rests binary, rid binary, pos binary")
    # pieces of known repeats go anywhere; a slice's pieces go to one task
    home = F.when(F.col("slice") < 0, F.xxhash64("rid")).otherwise(F.xxhash64("slice", "part"))
    return saved(cut.repartition(home).sortWithinPartitions("slice", "part").mapInArrow(merge, TOLD), files, spread=True)


def repeated(docs: DataFrame) -> list[DataFrame]:
    """``rid, pos``: all ranges of suffixes that repeat, of the bodies of ``docs``; a written table of each sort."""
    units = bodies(docs).select(F.col("rid").alias("uid"), "rid", F.lit(0).cast("long").alias("lo"), "body").filter(F.octet_length("body") >= LENGTH)
    files = file_count(docs)
    out = []
    for gram in GRAMS:
        found = candidates(units, gram, files)
        drop_shuffles(docs.sparkSession)
        done = suffix_sort(units, found, gram, files)
        discard(found)
        drop_shuffles(docs.sparkSession)
        out.append(done.filter(f"kind = {COVERED}").select("text").mapInArrow(covered_ranges, "rid bigint, pos bigint"))
        lo = F.shiftright("pos", 16)
        units = done.filter(f"kind = {OPEN}").select(F.xxhash64("rid", "pos").alias("uid"), "rid", lo.alias("lo"), F.col("text").alias("body"))
    return out


def removed(docs: DataFrame, covered: DataFrame, step: Callable, schema: str) -> DataFrame:
    """Join each document with its covered ranges and map both by ``step(batch, list of (first, stop) byte spans)``."""
    spans = covered.groupBy("rid").agg(F.collect_set("pos").alias("at"))  # bounded by the document's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            yield step(batch, [byte_spans(at) for at in batch.column("at").to_pylist()])

    return docs.join(spans, "rid", "left").mapInArrow(run, schema)


def whole(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def byte_spans(at: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from ranges of repeats' starts."""
    if not at:
        return []
    start, _, count = unpacked(np.sort(np.array(at, np.int64)))
    stop = np.maximum.accumulate(start + count - 1 + LENGTH)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    return [*zip(start[new].tolist(), np.append(stop[:-1][new[1:]], stop[-1:]).tolist())]


def kept_bytes(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(body[at:lo])
        at = hi
    out.append(body[at:])
    return b"".join(out)


def bodies(docs: DataFrame, *more: str) -> DataFrame:
    """Rows with their bytes and ``rid``, a 64-bit hash of id and text."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, body).alias("rid"), doc_id.alias("doc_id"), body.alias("body"), *more)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    bounded_batches(docs.sparkSession)

    def step(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        all_bodies = batch.column("body").to_pylist()
        n = [len(b) for b in all_bodies]
        gone = [sum(hi - lo for lo, hi in s) for s in spans]
        sha = [hashlib.sha256(kept_bytes(b, s)).hexdigest() for b, s in zip(all_bodies, spans)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = removed(bodies(docs), whole(repeated(docs)), step, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.repartition(file_count(docs))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character that loses only some of its bytes goes as a whole. Other columns stay."""
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"other_{k}" for k in range(len(others))]
    rows = bodies(docs, *(F.col(f"`{c}`").alias(n) for c, n in zip(others, names)))

    def step(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        text = [kept_bytes(b, s).decode("utf-8", "ignore") for b, s in zip(batch.column("body").to_pylist(), spans)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), *(batch.column(n) for n in names)], ["doc_id", "text", *names])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = removed(rows, whole(repeated(docs)), step, "doc_id bigint, text string" + (f", {kinds}" if kinds else ""))
    back = dict(zip(others, names)) | {"doc_id": "doc_id", "text": "text"}
    return out.select(*(F.col(back[c]).alias(c) for c in docs.columns)).coalesce(file_count(docs, 8))
