"""Benchmark decontamination by template canonicalisation (operator 1); DataFrame functions only.

A text becomes a row of words. Numbers, numbers with a unit and names (runs of capitalised words inside a
sentence) are replaced by one typed placeholder each and the rest is lower-cased: that is the template. Hashes of
template windows are joined between documents and benchmark items; matches on one diagonal (document
place minus item place) form an alignment, and along it the slots are compared: each slot value of the
item must stand for one value in the document everywhere. So a question with other numbers, names or
units is found, and a chance likeness of templates is not.

A pair is reported if its alignment is consistent and its windows cover ``SHARE`` of the item's words or
``RUN`` words. Windows with fewer than half plain words find no pair by their template: there the words
themselves must be equal, or plainer windows must have found the same alignment. Items with fewer than ``WINDOW`` words are matched whole. Texts that are null, empty or
without words match nothing; repeated rows give one row for each pair of ids, and so do different texts of one id, which are matched apart. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import file_count, saved

WINDOW = 8
SHARE = 0.5
RUN = 13
#: Item windows (about 100 bytes each) and document ids up to these numbers, and items' words up to so many characters, are broadcast, else they are shuffled.
BROADCAST_WINDOWS = 200_000
BROADCAST_DOCUMENTS = 100_000
BROADCAST_CHARACTERS = 10_000_000

#: Units that may follow a number, lower case.
UNITS = "mm cm m km mg g kg t ml l s sec min h hr hrs ms ft in yd mi lb lbs oz mph kmh pct percent usd eur gbp dollars dollar euros euro cents cent meters meter metres metre kilometers kilometres miles mile inches inch feet foot grams gram kilograms kilogram pounds pound liters litres liter litre seconds second minutes minute hours hour days day weeks week months month years year degrees degree"
NUMBER, NAME, UNIT = "\x01n", "\x01p", "\x01u"
#: What stands between the words of one name, and a run of name words. The run is possessive: Java matches it in a loop, else by a call for each word, which long runs end by a stack overflow.
TIES = "[ '\u2019-]"
NAMES = f"(?<=[\\p{{L}}\\p{{N}},] )\\p{{Lu}}\\p{{L}}*(?:{TIES}\\p{{Lu}}\\p{{L}}*)*+"
GAP = "[^\\p{L}\\p{N}\x01]+"


def spaced(text: Column) -> Column:
    """The text without what marks slots here, decimal points and thousands' commas; digits and letters stand apart."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x03]", " "), "(?<=\\d)[.,](?=\\d)", "")
    return F.regexp_replace(t, "(?<=\\p{Nd})(?=\\p{L})|(?<=\\p{L})(?=\\p{Nd})", " ")


def words(text: Column) -> Column:
    """The words as they are spelled."""
    return F.split(F.trim(F.regexp_replace(spaced(text), GAP, " ")), " ")


def template(text: Column) -> Column:
    """The words with placeholders, one for a run of name words and one for a number with its unit. Names are told by their capital behind a word or a comma, before punctuation is lost."""
    t = F.regexp_replace(spaced(text), NAMES, NAME)
    t = F.trim(F.regexp_replace(t, GAP, " "))
    t = F.regexp_replace(t, "(?<![^ ])\\p{N}+(?![^ ])", NUMBER)
    t = F.regexp_replace(F.lower(t), f"{NUMBER} (?:{'|'.join(UNITS.split())})(?![^ ])", UNIT)
    return F.split(t, " ")


def values(text: Column) -> Column:
    """``template`` with each slot's lower-cased value behind its placeholder, the words of a value tied by \x02; as many places."""
    parts = F.split(F.regexp_replace(spaced(text), f"({NAMES})", "\x03$1\x03"), "\x03", -1)
    t = F.array_join(F.transform(parts, lambda v, i: F.when(i % 2 == 1, F.concat(F.lit(NAME), F.regexp_replace(v, TIES, "\x02"))).otherwise(v)), "")
    t = F.trim(F.regexp_replace(t, GAP.replace("\x01", "\x01\x02"), " "))
    t = F.regexp_replace(t, "(?<![^ ])(\\p{N}+)(?![^ ])", f"{NUMBER}$1")
    t = F.regexp_replace(F.lower(t), f"{NUMBER}([^ ]+) ({'|'.join(UNITS.split())})(?![^ ])", f"{UNIT}$1\x02$2")
    return F.split(t, " ")


def n_words(value: Column) -> Column:
    return F.size(F.split(value, "\x02"))


def hashed(df: DataFrame, key: str, literal: bool = False) -> DataFrame:
    """``key, text_key, hs``: a hash of the text and of each template word, and ``ls`` of each lower-cased word if asked. No row is filtered by its template, which would compute it twice."""
    text = F.col("text").cast("string")
    own = [F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)).alias("ls")] if literal else []
    return df.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("text_key"), F.transform(template(text), lambda w: F.xxhash64(w)).alias("hs"), *own)


def plain_enough(v: Column, window: int) -> Column:
    """At least half of the window's words, or of ``window`` of them, are plain."""
    spelled = F.aggregate(v, F.lit(0), lambda a, w: a + n_words(w))
    return 2 * F.size(F.filter(v, lambda w: ~w.startswith("\x01"))) >= F.least(spelled, F.lit(window))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``h, item_id, item_pos, k, item_words, literal, wide`` of each item's windows.

    A template window with fewer than half plain words is like any other row of slots, so it finds no pair by itself.
    An item that has such windows or slots of several words is ``wide``: it is met by the windows of its lower-cased words too (``literal``).
    """
    text = F.col("text").cast("string")
    t = benchmark.select(F.col("item_id").cast("long").alias("item_id"), template(text).alias("t"), values(text).alias("v"), words(F.lower(text)).alias("w")).filter("w[0] <> '' and item_id is not null").distinct()
    k = F.least(F.size("t"), F.lit(window))
    heavy = F.exists(F.sequence(F.lit(0), F.size("t") - k), lambda i: ~plain_enough(F.slice("v", i + 1, k), window))
    t = t.withColumn("wide", heavy | (F.size("t") < F.size("w"))).withColumn("item_words", F.size("w"))
    kinds = F.array(F.struct("t", "v", F.lit(False).alias("literal")), F.struct(F.col("w").alias("t"), F.col("w").alias("v"), F.lit(True).alias("literal")))
    t = t.select("item_id", "wide", "item_words", F.inline(kinds)).filter("wide or not literal")
    t = t.select("item_id", "wide", "literal", "v", "item_words", k.alias("k"), F.transform("t", lambda w: F.xxhash64(w)).alias("hs"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.size("hs") - F.col("k"))).alias("item_pos"))
    own = F.slice("v", F.col("item_pos") + 1, F.col("k"))
    return t.filter(F.col("literal") | plain_enough(own, window)).select(F.xxhash64(F.slice("hs", F.col("item_pos") + 1, F.col("k"))).alias("h"), "item_id", "item_pos", "k", "item_words", "literal", "wide")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, item_id, k, item_words, literal, wide, pos, item_pos`` of equal windows; one pass over the texts for all window lengths."""
    kinds = sorted((r["literal"], r["k"]) for r in items.select("literal", "k").distinct().collect())  # at most twice ``window`` rows
    literal = any(own for own, _ in kinds)
    small = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items
    each = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(own).alias("own")) for own, k in kinds or [(False, window)]))
    hs = hashed(docs, "doc_id", literal).select("*", F.inline(each))
    hs = hs.withColumn("hs", F.when(F.col("own"), F.col("ls")).otherwise(F.col("hs"))) if literal else hs
    places = F.when(F.size("hs") >= F.col("n"), F.sequence(F.lit(1), F.size("hs") - F.col("n") + 1))
    windows = hs.select("doc_id", "text_key", "n", "own", F.posexplode(F.transform(places, lambda i: F.xxhash64(F.slice("hs", i, F.col("n"))))).alias("pos", "h"))
    return windows.join(small, "h").filter("k = n and literal = own").select("doc_id", "text_key", "item_id", "k", "item_words", "literal", "wide", "pos", "item_pos")


def slots(texts: DataFrame, key: str) -> DataFrame:
    """``key, text_key, v, t``: the places with their values beside the template's."""
    return texts.select(F.col(key).cast("long").alias(key), F.xxhash64(F.col("text").cast("string")).alias("text_key"), values(F.col("text").cast("string")).alias("v"), template(F.col("text").cast("string")).alias("t"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """``doc_id, item_id, n_windows, covered_words, item_words, exact``: the documents that hold an item, re-parameterised or not."""
    items = saved(item_windows(benchmark, window), file_count(benchmark))
    found = matches(docs, items, window).withColumn("shift", F.col("pos") - F.col("item_pos")).filter("doc_id is not null")
    # a diagonal holds each item place once, so this group is bounded by the item's length
    diagonals = found.groupBy("doc_id", "text_key", "item_id", "shift", "k", "item_words", "literal", "wide").agg(F.array_sort(F.collect_set("item_pos")).alias("at"))
    steps = F.transform(F.sequence(F.lit(1), F.size("at")), lambda i: F.when(i == F.size("at"), F.col("k")).otherwise(F.least(F.col("k"), F.element_at("at", F.least(i + 1, F.size("at"))) - F.element_at("at", i))))
    diagonals = diagonals.withColumn("covered_words", F.aggregate(steps, F.lit(0), lambda a, x: a + x))
    enough = (F.col("covered_words") >= run) | (F.col("covered_words") >= share * F.col("item_words"))
    # a wide item's windows of slots have not been joined: they are counted below, along the diagonals that were found
    diagonals = saved(diagonals.filter(enough | (F.col("wide") & ~F.col("literal"))), file_count(docs))
    n = diagonals.count()
    ids = diagonals.select(F.col("doc_id").alias("own_id")).distinct()
    own = docs.select("doc_id", "text").join(F.broadcast(ids) if n <= BROADCAST_DOCUMENTS else ids, F.col("doc_id").cast("long") == F.col("own_id"), "left_semi")
    doc_words = slots(own, "doc_id").distinct().select("doc_id", "text_key", F.col("v").alias("dv"), F.col("t").alias("dt"))
    item_words = slots(benchmark, "item_id").distinct().select("item_id", F.col("v").alias("iv"), F.col("t").alias("it"))
    spelled_out = benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    pairs = diagonals.join(doc_words, ["doc_id", "text_key"]).join(F.broadcast(item_words) if spelled_out <= BROADCAST_CHARACTERS else item_words, "item_id")
    here = lambda i: (i + F.col("shift") >= 0) & (F.slice("it", i + 1, F.col("k")) == F.slice("dt", F.greatest(i + F.col("shift") + 1, F.lit(1)), F.col("k")))
    pairs = pairs.withColumn("at", F.when(F.col("wide") & ~F.col("literal"), F.filter(F.sequence(F.lit(0), F.greatest(F.size("it") - F.col("k"), F.lit(0))), here)).otherwise(F.col("at")))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("k") - 1))))
    both = lambda p: F.struct(F.try_element_at("iv", p + 1).alias("i"), F.try_element_at("dv", p + F.col("shift") + 1).alias("d"))
    pairs = pairs.withColumn("covered", covered).withColumn("places", F.when(F.col("literal"), F.array().cast("array<struct<i:string,d:string>>")).otherwise(F.transform("covered", both)))
    spelled = F.when(F.col("literal"), F.size("covered")).otherwise(F.aggregate("places", F.lit(0), lambda a, s: a + n_words(s["i"])))
    # a slot filled otherwise counts as one word, however many its value has
    equal = F.when(F.col("literal"), F.size("covered")).otherwise(F.aggregate("places", F.lit(0), lambda a, s: a + F.when(s["i"] == s["d"], n_words(s["i"])).otherwise(1)))
    pairs = pairs.withColumn("covered_words", equal).filter(enough | (~F.col("literal") & (F.size("covered") >= share * F.size("it"))))
    pairs = pairs.withColumn("covered_words", spelled)
    filled = F.array_distinct(F.filter("places", lambda s: s["i"].startswith("\x01")))
    pairs = pairs.withColumn("filled", filled)
    pairs = pairs.withColumn("consistent", F.size("filled") == F.size(F.array_distinct(F.transform("filled", lambda s: s["i"]))))
    pairs = pairs.withColumn("exact", F.forall("filled", lambda s: s["i"].eqNullSafe(s["d"])))
    best = F.struct(F.col("covered_words"), F.col("exact"), F.size("at").alias("n_windows"), F.col("item_words"))
    # where an alignment lies in the document, in words as spelled: equal words inside one with inconsistent slots don't count
    before = lambda p: F.when(F.col("literal"), p).otherwise(F.aggregate(F.slice("dv", 1, F.greatest(p, F.lit(0))), F.lit(0), lambda a, w: a + n_words(w)))
    lo = F.when(F.col("wide"), before(F.array_min("at") + F.col("shift")))
    hi = F.when(F.col("wide"), before(F.array_max("at") + F.col("k") + F.col("shift")))
    pairs = pairs.select("doc_id", "text_key", "item_id", "consistent", F.struct(best.alias("best"), "literal", lo.alias("lo"), hi.alias("hi")).alias("o"))
    both = pairs.groupBy("doc_id", "text_key", "item_id").agg(F.collect_list(F.when(F.col("consistent"), F.col("o"))).alias("ok"), F.collect_list(F.when(~F.col("consistent"), F.col("o"))).alias("bad"))
    inside = lambda o: o["literal"] & F.exists("bad", lambda x: (x["lo"] < o["hi"]) & (o["lo"] < x["hi"]))
    out = both.select("doc_id", "item_id", F.array_max(F.transform(F.filter("ok", lambda o: ~inside(o)), lambda o: o["best"])).alias("best")).filter("best is not null")
    out = out.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))  # an id may have several texts
    return out.select("doc_id", "item_id", *(F.col(f"best.{c}").alias(c) for c in ("n_windows", "covered_words", "item_words", "exact")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows with a null id are kept."""
    bad = saved(contaminated(docs, benchmark).select(F.col("doc_id").alias("__contaminated_id")).distinct(), file_count(docs))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_DOCUMENTS else bad
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__contaminated_id"), "left_anti")
