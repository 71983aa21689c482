"""N-gram Jaccard join by MinHash banding (operator 4).

Shingles are five consecutive words (lower case, ``\\w+``); a text with fewer words has one shingle, all
its words; a text without words has none and links to nothing. Texts with equal shingle sets form a
class, and only classes are compared. The band and row counts are the ones with most rows that reach the
target recall at the threshold. Classes are shuffled on band hashes; buckets of up to ``BUCKET`` classes
keep the pairs whose 8-bit MinHash signatures aren't far below the threshold, larger ones are kept whole.
What is so connected is a group; all of a group's pairs are verified on full shingle sets. A group's members are
packed in blocks by the sets' sizes, and blocks meet only where the sizes allow the threshold: a hot group's rows are
sent once for each such block, not for each pair, and tasks give counts and spanning edges, never pairs.

``class_id``: the smallest doc_id of the connected near-duplicate group. ``copy_of``: the smallest
doc_id with the same shingle set. ``n_links``: the number of other distinct texts of similarity >=
threshold. Null texts count as empty; repeated rows give repeated results, different texts under one id are told
apart by their text; rows with a null id get the class of their text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, drop_shuffles, file_count, mixed, saved, slices, texts, worker_memory
from .components import components

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Estimates below THRESHOLD by this are dropped: four standard deviations of 120 hashes at 0.8.
MARGIN = 0.155
#: Classes of a bucket whose signatures are compared; larger buckets are grouped as wholes, at no loss.
BUCKET = 1024
#: Classes and shingles that one block of a group holds, about.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Ids up to this number are broadcast (about 100 bytes each), else shuffled.
BROADCAST_IDS = 100_000
REMEMBERED = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class WordHashes(dict):
    """64-bit hashes of the words met."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = WordHashes()


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * ODD + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(s))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def of(self, s: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Band hashes and the signature's low bytes."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 512):
            np.minimum(low, (s[i : i + 512, None] * self.a + self.b).min(0), out=low)
        low = mixed(low)
        band = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            band = mixed(band * ODD + low[k :: self.rows])
        return band.view(np.int64), (low & np.uint64(255)).astype(np.uint8).tobytes()


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, set_key, text_key, n, bands, sig`` of each document; keys are null where there are no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("near", _hashes.clear)
        minhash = MinHash(bands, rows)
        for batch in slices(batches):
            out = []
            for t in texts(batch):
                s = shingle_set(t)
                if len(s):
                    out.append((set_key(s), hashlib.blake2b(t.encode(), digest_size=8).digest(), len(s), *minhash.of(s)))
                else:
                    out.append((None, None, 0, None, None))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "set_key", "text_key", "n", "bands", "sig"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, set_key binary, text_key binary, n bigint, bands array<bigint>, sig binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal integer keys, of a partition sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy() for k in keys])
        starts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = cols[:, a].tolist()
            if held and key != last:
                yield whole()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def parts(link: np.ndarray) -> np.ndarray:
    """The smallest place connected to each place of a symmetric boolean matrix."""
    n = len(link)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning(link: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the connected parts of ``ids``."""
    label = parts(link)
    return [(int(ids[label[k]]), int(ids[k])) for k in np.flatnonzero(label != np.arange(len(ids))).tolist()]


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def bucket_edges(classes: DataFrame, hashes: int, threshold: float, files: int) -> DataFrame:
    """``a, b``: edges that connect, in each bucket, the classes whose estimated similarity is not far below the threshold."""
    rows = classes.select("node", F.explode("bands").alias("h"))  # the band is part of its hash
    sizes = rows.groupBy("h").agg(F.count("*").alias("size"), F.min("node").alias("head")).filter("size > 1")
    rows = saved(rows.join(sizes, "h"), files)
    small = rows.filter(F.col("size") <= BUCKET).select("h", "node").join(classes.select("node", "sig"), "node")
    least = math.ceil(((threshold - MARGIN) * 255 / 256 + 1 / 256) * hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for g in grouped(batches, ["h"]):
            ids = g.column("node").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(len(ids), hashes)
            if len(ids) == 2:
                if np.count_nonzero(sig[0] == sig[1]) >= least:
                    out.append((int(min(ids)), int(max(ids))))
            else:
                order = np.argsort(ids)
                ids, sig = ids[order], sig[order]
                same = np.zeros((len(ids), len(ids)), np.uint8 if hashes < 256 else np.uint16)
                for k in range(hashes):
                    same += sig[:, k, None] == sig[None, :, k]
                out += spanning(same >= least, ids)
            if len(out) > 20_000:
                yield edge_batch(out)
                out = []
        yield edge_batch(out)

    near = small.repartition("h").sortWithinPartitions("h").mapInArrow(run, "a bigint, b bigint")
    large = rows.filter(F.col("size") > BUCKET).select(F.col("head").alias("a"), F.col("node").alias("b")).filter("a <> b")
    out = saved(near.union(large).distinct(), files)
    discard(rows)
    drop_shuffles(classes.sparkSession)
    return out


def blocked(groups: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members of groups with their block ``root, cls, sub`` and whether it is the group's only one, and the pairs of different blocks that may hold links.

    A small group is one block. In others ``cls`` is the logarithm of the set's size, in steps of which two span the
    threshold, and ``sub`` deals a class's members over blocks.
    """
    size = groups.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    single = (F.col("members") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    step = F.floor(F.log("n") / F.lit(math.log(1 / threshold) / 2) + 1e-9).cast("int")
    rows = groups.join(size.select("root", single.alias("single")), "root").withColumn("cls", F.when(F.col("single"), 0).otherwise(step))
    per = rows.groupBy("root", "cls", "single").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    per = per.select("root", "cls", "single", F.when(F.col("single"), 1).otherwise(F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int").alias("subs"))
    rows = rows.drop("single").join(per, ["root", "cls"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int")).drop("subs")
    left = per.filter("not single").select("root", F.col("cls").alias("c1"), F.col("subs").alias("n1"), F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("up"))
    right = per.select("root", F.col("cls").alias("c2"), F.col("subs").alias("n2"))
    pairs = left.join(right.withColumn("c", F.col("c2")), (left["root"] == right["root"]) & (F.col("c") == F.col("c1") + F.col("up"))).select(left["root"], "c1", "n1", "c2", "n2")
    pairs = pairs.select("root", "c1", "c2", "n2", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("s1"))
    pairs = pairs.select("root", "c1", "s1", "c2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("s2"))
    return rows, pairs.filter("c1 < c2 or s1 < s2")


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b`` (with each other, if None); by products over the shingles that more than one of them holds."""
    x = np.concatenate(a)
    if b is None:
        common, n = np.unique(x, return_counts=True)
        common = common[n > 1]
    else:
        y = np.concatenate(b)
        common = np.intersect1d(x, y)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, flat)
        hit = common[np.minimum(at, len(common) - 1)] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    out = np.zeros((len(a), len(a if b is None else b)), np.int64)
    if not len(common):
        return out
    own, at = places(a, x)
    other, to = (own, at) if b is None else places(b, y)
    width = max(64, (2 << 20) // max(out.shape))
    for lo in range(0, len(common), width):
        n = min(width, len(common) - lo)
        left = np.zeros((len(a), n), np.float32)
        pick = (at >= lo) & (at < lo + n)
        left[own[pick], at[pick] - lo] = 1
        if b is None:
            right = left
        else:
            right = np.zeros((len(b), n), np.float32)
            pick = (to >= lo) & (to < lo + n)
            right[other[pick], to[pick] - lo] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least ``threshold``; a set isn't paired with itself."""
    common = overlaps(a, b)
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in (a if b is None else b)])
    link = common >= threshold * (n[:, None] + m[None, :] - common) - 1e-9
    if b is None:
        np.fill_diagonal(link, False)
    return link


#: A block with its members' nodes, texts, smallest node linked inside, links so far, and sets (null where no other block needs them), all packed.
PACKED = "root bigint, cls int, sub int, nodes binary, weights binary, labels binary, links binary, sizes binary, sets binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
KINDS = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6)


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)] if rows else [pa.array([], k) for k in KINDS], NAMES)


def sets_of(sizes: bytes, sets: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(sets, np.uint64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])


def verified(docs: DataFrame, groups: DataFrame, threshold: float, files: int) -> DataFrame:
    """``a, b, n``: spanning edges of verified links (n null), and (node, null, links) counts of linked texts; from ``node, root, n, n_texts, rep, set_key``; written."""
    members, pairs = blocked(groups, threshold)
    members = members.select("rep", "set_key", "node", "n_texts", "root", "cls", "sub", "single")
    text = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    text = text.join(F.broadcast(members) if groups.count() <= BROADCAST_IDS else members, "rep")
    passed = ["node", "n_texts", "root", "cls", "sub", "single"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of the texts that the members stand for: other texts of an id, and the repeated rows of a batch, are left out."""
        worker_memory("near", _hashes.clear)
        for batch in slices(batches):
            keep, out, seen = [], [], set()
            for k, (t, wanted, node) in enumerate(zip(texts(batch), batch.column("set_key").to_pylist(), batch.column("node").to_pylist())):
                s = shingle_set(t) if node not in seen else None
                if s is not None and set_key(s) == wanted:
                    seen.add(node)
                    keep.append(k)
                    out.append(s.tobytes())
            kept = batch.select(passed).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.binary())], [*passed, "shingles"])

    def own_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for g in grouped(batches, ["root", "cls", "sub"]):
            nodes, first = np.unique(g.column("node").to_numpy(), return_index=True)  # a repeated row counts once
            rows = g.column("shingles").to_pylist()
            members = [np.frombuffer(rows[k], np.uint64) for k in first.tolist()]
            weights = g.column("n_texts").to_numpy()[first]
            link = similar(members, None, threshold)
            alone = g.column("single")[0].as_py()
            sizes = np.array([len(s) for s in members], np.int64).tobytes()
            out.append((g.column("root")[0].as_py(), g.column("cls")[0].as_py(), g.column("sub")[0].as_py(), nodes.tobytes(), weights.tobytes(), nodes[parts(link)].tobytes(), (link @ weights).tobytes(), sizes, None if alone else b"".join(s.tobytes() for s in members)))
            held += 32 * len(nodes) + len(out[-1][-1] or b"")
            if held > 1 << 20:
                yield packed_batch(out)
                out, held = [], 0
        yield packed_batch(out)

    def cross_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pair of blocks, the links that each side's members get, and edges that span the sides' connected parts."""
        for batch in batches:
            for x in batch.to_pylist():
                side = [{c: x[p + c] for c in NAMES} for p in ("", "to_")]
                link = similar(*(sets_of(s["sizes"], s["sets"]) for s in side), threshold)
                weights, labels = ([np.frombuffer(s[c], np.int64) for s in side] for c in ("weights", "labels"))
                i, j = np.nonzero(link)
                edges = np.unique(np.stack([labels[0][i], labels[1][j]]), axis=1)
                rows = [(s["root"], s["cls"], s["sub"], s["nodes"], None, None, n.tobytes(), None, None) for s, n in zip(side, (link @ weights[1], weights[0] @ link))]
                if edges.size:  # as a row without a block: nodes and labels are the edges' ends
                    rows.append((side[0]["root"], -1, -1, edges[0].tobytes(), None, edges[1].tobytes(), None, None, None))
                yield packed_batch(rows)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["root", "cls", "sub"]):
            edges: list[tuple[np.ndarray, np.ndarray]] = []
            total = None
            for nodes, labels, links in zip(*(g.column(c).to_pylist() for c in ("nodes", "labels", "links"))):
                nodes = np.frombuffer(nodes, np.int64)
                if labels is not None:
                    edges.append((np.frombuffer(labels, np.int64), nodes))
                if links is not None:
                    total = np.frombuffer(links, np.int64) + (0 if total is None else total)
            a, b = (np.concatenate(c) for c in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])
            if total is not None:
                some = total > 0
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.nulls(some.sum(), pa.int64()), pa.array(total[some])], ["a", "b", "n"])

    shingled = text.select("text", "set_key", *passed).mapInArrow(sets, "node bigint, n_texts bigint, root bigint, cls int, sub int, single boolean, shingles binary")
    block = ["root", "cls", "sub"]
    packed = saved(shingled.repartition(*block).sortWithinPartitions(*block).mapInArrow(own_links, PACKED), files, spread=True)
    several = packed.filter("sets is not null")
    left = several.join(pairs.select("root", F.col("c1").alias("cls"), F.col("s1").alias("sub"), "c2", "s2"), block)
    right = several.select(*(F.col(c).alias(f"to_{c}") for c in NAMES))
    both = left.join(right, (F.col("root") == F.col("to_root")) & (F.col("c2") == F.col("to_cls")) & (F.col("s2") == F.col("to_sub"))).drop("c2", "s2")
    cross = both.mapInArrow(cross_links, PACKED)
    counts = ["root", "cls", "sub", "nodes", "labels", "links"]
    rows = packed.select(*counts).unionByName(cross.select(*counts))
    out = saved(rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(summed, "a bigint, b bigint, n bigint"), files)
    discard(packed)
    drop_shuffles(docs.sparkSession)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` of every document."""
    bands, rows = bands_for(threshold, recall)
    files = file_count(docs)
    sketch = saved(sketched(docs, bands, rows))  # as many tasks as the input has
    some = sketch.filter("set_key is not null and doc_id is not null").select("doc_id", "set_key", "text_key", F.struct("n", "bands", "sig").alias("look"))
    first = some.groupBy("set_key", "text_key").agg(F.min("doc_id").alias("rep"), F.first("look").alias("look"))
    classes = first.groupBy("set_key").agg(F.min("rep").alias("rep"), F.count("*").alias("n_texts"), F.first("look").alias("look"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "rep", "n_texts", "look.*"), files)  # written, so the numbers stay
    edges = bucket_edges(classes, bands * rows, threshold, files)
    groups = saved(components(edges).join(classes.drop("bands", "sig"), "node"), files)
    links = verified(docs, groups, threshold, files)
    near = components(links.filter("b is not null").select("a", "b").distinct())
    counts = links.filter("n is not null").select(F.col("a").alias("node"), F.col("n").alias("links"))
    near = near.join(classes.select("node", "rep"), "node")
    least = near.groupBy("root").agg(F.min("rep").alias("class_id"))
    near = near.join(least, "root").select("node", "class_id")
    known = classes.select("node", "set_key", "rep", "n_texts").join(near, "node", "left").join(counts, "node", "left")
    known = saved(known.select(F.col("set_key").alias("key"), F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_of"), (F.col("n_texts") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), files)
    discard(classes, edges, groups, links)
    out = sketch.select("doc_id", "set_key").join(known, F.col("set_key") == F.col("key"), "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.repartition(files)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose id isn't the smallest of its near-duplicate group; rows with a null id are kept."""
    goes = saved(near_duplicates(docs, **how).filter("doc_id <> class_id").select(F.col("doc_id").alias("__goes")).distinct(), file_count(docs))
    goes = F.broadcast(goes) if goes.count() <= BROADCAST_IDS else goes
    return docs.join(goes, F.col("doc_id").cast("long") == F.col("__goes"), "left_anti")
