"""WARC writing and reading by boundary-chain verification (operator 9).

Writing: each page is one record; Spark's text writer puts the records' bytes into part files of a
bounded number of records, through its commit protocol and on any Hadoop file system. Of records with
equal payloads of at least ``REVISIT_BYTES`` bytes, that with the smallest page id is the response
and the others are revisits without payload; rows that share that smallest id are all responses.

Reading: each occurrence of the magic is a candidate record, and files are split between tasks. A candidate's
header gives its successor, the offset just behind the record. The tasks of the splits contract the chains: they tell
for each candidate where its chain leaves the split. Between the splits, pointers are jumped in doubling steps from
the files' starts, and the tasks then mark what the chain reaches from their split's entry.
Candidates that it doesn't reach are magic inside payloads and belong to the record before them. A chain that
leaves the candidates ends there: what follows a damaged record is dropped.

A null payload is written as an empty one, a null page id as an empty id that reads back as null.
Line ends inside a URL are removed. Repeated rows are written as often as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, file_count, saved, work_dir

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
#: Digests with repeated payloads are broadcast up to this number (about 64 bytes each), else shuffled.
BROADCAST_DIGESTS = 100_000


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """``digest, first_id`` of each payload of at least REVISIT_BYTES bytes that occurs more than once."""
    thin = pages.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    return thin.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")


def record(page: dict[str, Column]) -> Column:
    """A record's bytes without the last line feed, which the text writer adds."""
    revisit = page["refers_to"].isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(page["payload"])
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page["page_id"].cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(page["url"], F.lit("")), "[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), page["digest"], F.lit("\r\nWARC-Payload-Length: "), page["payload_bytes"].cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), page["refers_to"].cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "none") -> None:
    """Write ``page_id, url, html`` rows as WARC files below ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = saved(repeated_payloads(rows.drop("url")), file_count(pages))
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    rows = rows.join(again, "digest", "left")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id")))
    out = rows.select(record({c: F.col(c) for c in rows.columns}).alias("value"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The bytes behind each magic, with file, split and order: ``file, block, seq, bytes``. Files are split between tasks, alike in each read of a path."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("bytes"))


def field(head: Column, name: str, pattern: str) -> Column:
    out = F.regexp_extract(head, f"(?m)^{name}: {pattern}\r?$", 1)
    return F.when(out != "", out)


def candidates(rows: DataFrame) -> DataFrame:
    """Each candidate's size, its header's length and fields, and the digest of the payload bytes that stand in its own chunk."""
    text = F.decode(F.col("bytes"), "ISO-8859-1")  # a character for each byte
    end = F.instr(text, "\r\n\r\n")
    rows = rows.withColumn("size", F.octet_length("bytes").cast("long")).withColumn("head_bytes", F.when(end > 0, end + 3).cast("long")).withColumn("head", F.concat(F.decode(F.expr("substring(bytes, 1, int(head_bytes) - 4)"), "UTF-8"), F.lit("\r")))
    rows = rows.withColumn("block_bytes", field(F.col("head"), "Content-Length", "(\\d{1,17})").cast("long"))
    own = F.expr("substring(bytes, int(head_bytes) + 1, int(least(block_bytes, 2000000000)))")
    return rows.select(
        "file", "block", "seq", "size", "block_bytes", "head_bytes",
        field(F.col("head"), "WARC-Type", "(\\w+)").alias("record_type"),
        field(F.col("head"), "WARC-Record-ID", "<urn:page:(-?\\d+)>").cast("long").alias("page_id"),
        field(F.col("head"), "WARC-Refers-To", "<urn:page:(-?\\d+)>").cast("long").alias("refers_to"),
        field(F.col("head"), "WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("stated_digest"),
        field(F.col("head"), "WARC-Payload-Length", "(\\d{1,18})").cast("long").alias("stated_bytes"),
        F.sha2(own, 256).alias("own_digest"),
    )


def jumps(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The place of each candidate's successor among the ascending offsets; their number where it isn't one of them."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    return np.append(np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n), n) if n else np.zeros(1, np.int64)


def reachable(offset: np.ndarray, successor: np.ndarray, entry: int = 0) -> np.ndarray:
    """Which candidates the chain from the one at ``entry`` reaches; ``offset`` ascending, ``successor`` -1 where there is none. Jumps double each step."""
    n = len(offset)
    jump = jumps(offset, successor)
    reached = np.append(offset == entry, False)
    for _ in range(max(1, int(n).bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def exits(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """For each candidate, the successor of the last one of its chain; jumps double each step."""
    n = len(offset)
    jump = jumps(offset, successor)
    last = np.arange(n + 1)
    jump = np.where(jump < n, jump, last)  # the last of a chain stays where it is
    for _ in range(max(1, int(n).bit_length())):
        jump = jump[jump]
    return successor[jump[:n]]


def by_split(rows: DataFrame, step: Callable[[pa.Table], dict[str, pa.Array]], more: str) -> DataFrame:
    """``rows`` with the columns that ``step`` makes of each split's rows, which are bounded by the split's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            for name, column in step(whole).items():
                whole = whole.append_column(name, column)
            yield from whole.to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pc.or_(pc.not_equal(batch["file"][1:], batch["file"][:-1]), pc.not_equal(batch["block"][1:], batch["block"][:-1]))
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                own = (batch["file"][a].as_py(), batch["block"][a].as_py())
                if held and own != key:
                    yield from done()
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition("file", "block").sortWithinPartitions("file", "block", "seq").mapInArrow(run, f"{schema}, {more}")


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t[name], -1).to_numpy()


def linked(t: pa.Table) -> dict[str, pa.Array]:
    """Offsets, successors and where each candidate's chain leaves the split. What stands before a file's first magic is no candidate and has a negative offset."""
    step = numbers(t, "size") + len(MAGIC)
    offset = t["base"][0].as_py() + np.cumsum(step) - step - len(MAGIC)
    head, block = numbers(t, "head_bytes"), numbers(t, "block_bytes")
    successor = np.where((head >= 0) & (block >= 0) & (offset >= 0), offset + len(MAGIC) + head + block + 4, -1)
    return {"offset": pa.array(offset), "successor": pa.array(successor), "exit": pa.array(exits(offset, successor))}


def marked(t: pa.Table) -> dict[str, pa.Array]:
    """What the chain reaches from the split's entry, and the record that each candidate stands in, if it begins in this split."""
    offset, entry = numbers(t, "offset"), numbers(t, "entry")[0]
    got = reachable(offset, numbers(t, "successor"), int(entry)) if entry >= 0 else np.zeros(len(offset), bool)
    owner = np.maximum.accumulate(np.where(got, offset, -1))
    return {"reached": pa.array(got), "owner": pa.array(owner, mask=owner < 0)}


def split_entries(chains: DataFrame) -> DataFrame:
    """``file, block, entry``: where the chains from the files' starts enter each split. The table that is jumped over has a few rows for each split, those that some chain enters."""
    ends = chains.filter("exit >= 0").select("file", F.col("exit").alias("offset")).distinct()
    doors = saved(chains.select("file", "block", "offset", "exit").join(ends.unionByName(chains.filter("offset = 0").select("file", "offset")).distinct(), ["file", "offset"], "left_semi"), 8)
    reached, jump = doors.filter("offset = 0").select("file", "offset"), doors.select("file", "offset", "exit")
    n = reached.count()
    while True:
        there = jump.join(reached, ["file", "offset"], "left_semi").select("file", F.col("exit").alias("offset"))
        reached = saved(reached.union(there.join(doors, ["file", "offset"], "left_semi")).distinct(), 8)
        was, n = n, reached.count()
        if n == was:
            return reached.join(doors, ["file", "offset"]).select("file", "block", F.col("offset").alias("entry"))
        beyond = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("to"))
        jump = saved(jump.join(beyond, ["file", "exit"]).select("file", "offset", F.col("to").alias("exit")), 8)


def joined_payloads(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """``file, offset, digest`` of records whose payload holds magic, hashed chunk after chunk, each record in one task; from their chunks' places. Written."""
    small = parts.count() <= BROADCAST_DIGESTS
    raw = chunks(spark, path).join(F.broadcast(parts) if small else parts, ["file", "block", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        record, sha, left, expected = None, None, 0, 0
        out: list[tuple] = []
        for batch in batches:
            for file, owner, offset, body, size, head, block in zip(*(batch[c].to_pylist() for c in ("file", "owner", "offset", "bytes", "size", "own_head", "own_block"))):
                if (file, owner) != record:
                    if record:
                        out.append((*record, sha.hexdigest()))
                    record, sha, left, expected = (file, owner), hashlib.sha256(), block, offset
                    bytes_here = body[head:]
                else:
                    bytes_here = MAGIC.encode() + body
                if len(body) != size or offset != expected:
                    raise RuntimeError("the archives' splits changed between two reads")
                expected = offset + len(MAGIC) + size
                sha.update(bytes_here[:left])
                left -= min(left, len(bytes_here))
        if record:
            out.append((*record, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 3, (pa.string(), pa.int64(), pa.string()))], ["file", "offset", "digest"])

    rows = raw.repartition("file", "owner").sortWithinPartitions("file", "owner", "offset")
    return saved(rows.mapInArrow(run, "file string, offset bigint, digest string"), file_count(spark.read.text(path)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, page_id, record_type, refers_to, payload_bytes, payload_digest`` of each record of the archives below ``path``."""
    files = file_count(spark.read.text(path))
    cands = saved(candidates(chunks(spark, path)), files)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = cands.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    base = splits.select("file", "block", F.coalesce(F.sum("total").over(in_file), F.lit(0)).alias("base"))  # one row for each split
    chains = saved(by_split(cands.join(base, ["file", "block"]), linked, "offset bigint, successor bigint, exit bigint").drop("base"), files)
    discard(cands)
    entries = split_entries(chains)
    rows = saved(by_split(chains.join(entries, ["file", "block"], "left"), marked, "reached boolean, owner bigint").drop("entry", "exit", "successor"), files)
    discard(chains)
    # what stands in a split before its first record belongs to the last record of the splits before
    last = rows.groupBy("file", "block").agg(F.max("owner").alias("last"))
    before = last.select("file", "block", F.max("last").over(in_file).alias("before"))
    stray = rows.filter("not reached and offset >= 0").join(before, ["file", "block"]).withColumn("owner", F.coalesce("owner", "before")).filter("owner is not null")
    out = rows.filter("reached")
    if not stray.isEmpty():
        odd = out.join(stray.select("file", F.col("owner").alias("offset")).distinct(), ["file", "offset"], "left_semi")
        place = ["file", "block", "seq", "offset", "size", "owner"]
        pieces = odd.select(*place).unionByName(stray.select(*place)).join(odd.select("file", F.col("offset").alias("owner"), F.col("head_bytes").alias("own_head"), F.col("block_bytes").alias("own_block")), ["file", "owner"])
        out = out.join(joined_payloads(spark, path, saved(pieces, files)), ["file", "offset"], "left").withColumn("own_digest", F.coalesce("digest", "own_digest"))
    full = F.col("record_type") == "response"
    return out.select(
        "file", "offset", "page_id", "record_type", "refers_to",
        F.when(full, F.col("block_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(full, F.col("own_digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    path = work_dir(pages.sparkSession) + "/warc"
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
