"""Mix of sources to target weights: a low-discrepancy schedule of blocks of equal numbers of words.

Each source's documents stand in a shuffled order and are cut every ``BLOCK`` words. Slots of the mix are van der
Corput points, in whole numbers below 2 to the ``DIGITS``; the source in whose share of the cumulated weights a point
lies has the slot. A slot's rank within its source is the number of earlier points in that share, which follows from
the binary digits of its limits, so slots are ranked without a shuffle. Slots and blocks, shuffled anew for each pass
over a source, meet by (source, pass, rank). Everything is joins, windows over buckets of bounded size and column
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Words of a block; the last block of a source may be shorter.
BLOCK = 1024
#: The weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a bucket in whose window running sums are taken, about.
BUCKET = 4096
#: Binary digits of the points.
DIGITS = 40
#: Fixed value: what parts words.
WORD = "[^\\x20\\x09-\\x0D]+"


def scrambled(*columns: Column) -> Column:
    """60 bits that put rows into an order of no pattern, the same in every run."""
    digits = F.substring(F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def bucket_of(rank: str, rows: int) -> Column:
    """The leading bits of a 60-bit rank, so that buckets of so many rows have some BUCKET each."""
    return F.shiftright(rank, 60 - max(0, (rows // BUCKET).bit_length()))


def running(rows: DataFrame, groups: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over earlier rows of the group; windows hold a bucket's rows or a group's buckets."""
    rows = rows.withColumn("__bucket", bucket).withColumn("__value", value)
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*groups, "__bucket").agg(F.sum("__value").alias("__total"))
    across = Window.partitionBy(*groups or [F.lit(0)]).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(across), F.lit(0))).drop("__total")
    out = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(starts, [*groups, "__bucket"])
    return out.withColumn(name, F.col("__start") + F.col("__inside")).drop("__bucket", "__value", "__inside", "__start")


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """``name``: the row's place from 0, from a sort by ranges and the sums of its partitions' sizes, one row for each partition."""
    at = saved(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = at.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(sizes.select("__part", before.alias("__before")), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__at", "__part", "__before")


def whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``target`` (double) and ``wanted`` (whole words) of sources with ``place`` and ``source_size``.

    ``share`` of all words is divided by weight; a target stops at ``most`` times its source's size, and what is
    left goes to the others by weight until none is above. Only whole numbers decide: the level is a fraction, and
    each round brings one row of sums to the driver.
    """
    up, down = share
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("decimal(9,0)")
    cap = (F.lit(most) * F.col("source_size")).cast("decimal(19,0)")
    rows = sources.withColumn("weight", weight).withColumn("cap", cap)
    total = int(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    capped, count = F.lit(False), -1
    while True:
        row = rows.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("c"), F.count(F.when(capped, 1)).alias("n")).first()
        above, below = up * total - down * int(row["c"]), down * int(row["w"] or 1)  # words for a weight of 1
        if row["n"] == count:
            break
        count, capped = row["n"], whole(above) * F.col("weight") > F.col("cap") * whole(below)
    wanted = F.expr(f"({above}BD * weight * 2 + {below}BD) div ({2 * below}BD)")
    return rows.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(float(above)) * F.col("weight").cast("double") / F.lit(float(below)))).withColumn("wanted", F.when(capped, F.col("cap").cast("long")).otherwise(wanted)).drop("cap")


def reversed_digits(c: str) -> Column:
    return F.conv(F.reverse(F.lpad(F.conv(F.col(c).cast("string"), 10, 2), DIGITS, "0")), 2, 10).cast("long")


def earlier_below(i: str, limit: str, turned: str) -> str:
    """SQL of how many of the first ``i`` points lie below ``limit``, whose reversed digits are ``turned``.

    A digit p of the limit that is 1 gives an interval of width 2 to the -p, in which point j lies if j has one
    certain remainder by 2 to the p.
    """
    each = f"(shiftright({turned}, p - 1) & 1L) * shiftright({i} + shiftleft(1L, p) - 1 - ({turned} & (shiftleft(1L, p - 1) - 1)), p)"
    return f"CASE WHEN {limit} >= {1 << DIGITS}L THEN {i} ELSE aggregate(sequence(1, {DIGITS}), 0L, (s, p) -> s + {each}) END"


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, place, rank`` of all slots: as many of each source as its ``quota``, whose sum is the number of points.

    Points deal a source its quota but for a few slots (fewer than 64): those over it go, missing ones follow behind
    all points.
    """
    spark = sources.sparkSession
    n, rows = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    limits = running(sources, [], F.expr(f"place div {BUCKET}"), ["place"], F.col("quota"), "before")
    limit = lambda c: F.expr(f"(cast({c} as decimal(20,0)) * {1 << DIGITS}BD) div {max(n, 1)}BD")
    limits = limits.withColumn("low", limit("before")).withColumn("high", limit("(before + quota)"))
    limits = saved(limits.withColumn("low_turned", reversed_digits("low")).withColumn("high_turned", reversed_digits("high")))
    cut = DIGITS - max(12, (4 * rows).bit_length())
    shares = limits.filter("high > low").select("place", "quota", "low", "high", "low_turned", "high_turned", F.explode(F.expr(f"sequence(shiftright(low, {cut}), shiftright(high - 1, {cut}))")).alias("cell"))
    points = spark.range(0, n, 1, max(8, n // 200_000)).withColumnRenamed("id", "slot").withColumn("point", reversed_digits("slot")).withColumn("cell", F.shiftright("point", cut))
    dealt = points.join(shares, "cell").filter("point >= low AND point < high")
    rank = F.expr(f"{earlier_below('slot', 'high', 'high_turned')} - {earlier_below('slot', 'low', 'low_turned')}")
    dealt = dealt.withColumn("rank", rank).filter("rank < quota").select("slot", "place", "rank")
    have = F.expr(f"{earlier_below(f'{n}L', 'high', 'high_turned')} - {earlier_below(f'{n}L', 'low', 'low_turned')}")
    missing = limits.withColumn("have", have).filter("have < quota").select("place", "have", F.explode(F.expr("sequence(have, quota - 1)")).alias("rank"))
    behind = missing.select((F.lit(n) + F.col("place") * 64 + F.col("rank") - F.col("have")).alias("slot"), "place", "rank")
    return dealt.unionByName(behind)


def placed(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """Documents' rows (``doc_id, text_key, size, place, start``: the first word's number in the source's shuffled order) and the sources' table, both saved."""
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_key"), (F.monotonically_increasing_id() % 256).alias("salt"))
    # equal rows are counted, in up to 256 groups so that none is very large
    sized = saved(narrow.groupBy("doc_id", "source", "size", "text_key", "salt").agg(F.count("*").alias("copies")))
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = targets(saved(numbered(totals, F.col("source").asc_nulls_last(), "place")), weights)
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    passes = F.expr("CASE WHEN source_size > 0 THEN wanted div source_size ELSE 0 END")
    quota = F.expr(f"passes * blocks + (wanted - passes * source_size + {block - 1}) div {block}")
    sources = saved(sources.withColumn("blocks", blocks).withColumn("passes", passes).withColumn("quota", quota))
    rows = int(sized.count())
    salted = sources.select("source", "place", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("spread"))  # a hot source is sixteen keys
    own = sized.withColumn("spread", F.pmod("text_key", F.lit(16)).cast("int"))
    own = own.alias("d").join(salted.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.spread") == F.col("s.spread"))).select("doc_id", "size", "text_key", "salt", "copies", "place", scrambled(F.col("doc_id")).alias("h"))
    own = running(own, ["place"], bucket_of("h", rows), ["h", "doc_id", "size", "text_key", "salt"], F.col("size") * F.col("copies"), "start")
    each = own.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("start", F.expr("start + copy * size"))
    return saved(each.select("doc_id", "text_key", "size", "place", "start")), sources


def mix_of(placed_docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``mix`` from what ``placed`` has made; rows also have ``place`` and ``start``."""
    last = f"(start + size - 1) div {block}"
    pieces = placed_docs.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, {last})")))
    pieces = pieces.withColumn("first_word", F.expr(f"greatest(0L, block * {block} - start)")).withColumn("offset", F.expr(f"greatest(0L, start - block * {block})"))
    pieces = pieces.withColumn("n", F.expr(f"least(size - first_word, {block} - offset)"))
    found = pieces.groupBy("place", "block").agg(F.sum("n").alias("words"))
    columns = ["place", "source_size", "wanted", "blocks", "passes"]
    spread = sources.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(15))).alias("spread"))
    found = found.withColumn("spread", (F.col("block") % 16).cast("int")).join(spread, ["place", "spread"])
    passes = found.withColumn("pass", F.explode(F.expr("sequence(0L, passes)"))).withColumn("h", scrambled(F.col("place"), F.col("pass"), F.col("block")))
    full = passes.filter(F.col("words") == block)
    n = int(sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
    full = running(full, ["place", "pass"], bucket_of("h", n), ["h", "block"], F.lit(1), "turn")
    short = passes.filter(F.col("words") < block).withColumn("turn", F.col("blocks") - 1)  # comes last in each pass
    turns = full.unionByName(short).withColumn("rank", F.expr("pass * blocks + turn")).withColumn("take", F.expr(f"least(words, wanted - pass * source_size - turn * {block})"))
    taken = turns.filter("take > 0").join(schedule(sources), ["place", "rank"]).select("slot", "place", "block", "pass", "take")
    out = taken.join(pieces, ["place", "block"]).withColumn("n_words", F.expr("least(n, take - offset)")).filter("n_words > 0")
    return out.select("slot", "place", "pass", "block", "offset", "doc_id", "text_key", "size", "start", "first_word", "n_words")


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus as spans: in ``slot`` (ascending, with gaps), words ``first_word`` (from 0) to ``first_word + n_words`` of a document, ``offset`` words behind the slot's start.

    ``text_key`` (xxhash64 of the text) tells texts of one id apart. Sizes, weights and targets as in ``mixed_words``.
    """
    rows, sources = placed(docs, block, weights)
    out = mix_of(rows, sources, block).join(F.broadcast(sources.select("place", "source")) if sources.count() <= 10_000 else sources.select("place", "source"), "place")
    return out.drop("place", "start", "size")


def mixed_words(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs``.

    Columns ``doc_id, source, text`` are read, others ignored. A null text has no words, a null source is the last
    source, null ids are shuffled as one. Equal rows each have their own places. A source's taken words are its
    target to the nearest whole word; a source without words has target 0. An empty table gives no rows.
    """
    rows, sources = placed(docs, block, weights)
    used = mix_of(rows, sources, block).select("place", "start", F.col("n_words").alias("taken"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("size"))
    own = rows.filter("size > 0").select("place", "start", F.lit(0).cast("long").alias("taken"), "doc_id", "size")
    summed = own.unionByName(used).groupBy("place", "start").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
    every = summed.select("place", "doc_id", "size", "taken").unionByName(rows.filter("size = 0").select("place", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    spread = sources.select("place", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("spread"))
    out = every.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(spread, ["place", "spread"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


def texts(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """The words of each span of ``mix``, joined by blanks: ``slot, offset, text``."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["doc_id", "text_key"])
    both = mixed.alias("m").join(own.alias("o"), F.col("m.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("m.text_key") == F.col("o.text_key")))
    words = F.regexp_extract_all("o.text", F.lit(WORD), F.lit(0))
    return both.select("m.slot", "m.offset", F.array_join(F.slice(words, (F.col("m.first_word") + 1).cast("int"), F.col("m.n_words").cast("int")), " ").alias("text"))
