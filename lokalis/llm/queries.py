"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, html_text, license_scan, mixing, near_duplicates, quality_rules, snapshot_diff, substring_dedup, token_counts, toxicity, warc
from .common import table


def vocabulary_path() -> str:
    """The byte-level vocabulary of the installed public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op12_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return snapshot_diff.difference(docs, snapshot_diff.later_snapshot(docs), "doc_id", "text", ["text", "lang", "source"])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_license_scans, op3_html_extraction, op4_jaccard_join, op5_toxicity, op6_suffix_dedup, op7_bpe, op8_quality_rules, op9_warc, op10_token_counts, op11_mixing, op12_snapshot_difference, op13_collocations)
}

OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

#: Words, sources in the order of their names, the level at which all targets together are 150 % of all words, then blocks of 1024 words and the words that the wanted number takes of each.
OP11_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST(place % 3 + 1 AS INT)] AS HUGEINT) AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), place) AS turn FROM w),
c AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  2 * sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM r),
l AS (SELECT above, below FROM c WHERE above * weight <= 2 * source_size * below ORDER BY turn LIMIT 1),
t AS (SELECT place, source, source_size, above * weight > 2 * source_size * below AS capped, l.above, l.below, c.weight FROM (SELECT place, source, source_size, weight FROM c) c, l),
g AS (SELECT place, source, CAST(source_size AS BIGINT) AS source_size,
  CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(above AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(below AS DOUBLE) END AS target,
  CAST(CASE WHEN capped THEN 2 * source_size ELSE (above * weight * 2 + below) // (2 * below) END AS BIGINT) AS wanted, CAST((source_size + 1023) // 1024 AS BIGINT) AS blocks FROM t),
o AS (SELECT d.doc_id, d.size, g.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15) AS BIGINT) AS h FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, row_number() OVER () AS rid, CAST(coalesce(sum(size) OVER (PARTITION BY place ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o),
b AS (SELECT place, source_size, wanted, blocks, unnest(range(blocks)) AS block FROM g),
q AS (SELECT *, unnest([0, 1]) AS pass FROM b),
k AS (SELECT *, least(1024, source_size - block * 1024) AS words, row_number() OVER (PARTITION BY place, pass ORDER BY least(1024, source_size - block * 1024) < 1024,
  CAST('0x' || substr(md5(place || '|' || pass || '|' || block), 1, 15) AS BIGINT), block) - 1 AS turn FROM q),
a AS (SELECT place, block, greatest(0, least(words, wanted - pass * source_size - turn * 1024)) AS take FROM k),
e AS (SELECT *, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM p WHERE size > 0),
u AS (SELECT e.rid, sum(greatest(0, least(least(e.start + e.size, e.block * 1024 + a.take) - greatest(e.start, e.block * 1024), e.size))) AS taken FROM e JOIN a ON e.place = a.place AND e.block = a.block GROUP BY e.rid)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target, CAST(coalesce(u.taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN u ON p.rid = u.rid
"""

#: The remainder of crc32 by 16 bit by bit: a byte is XOR-ed in and shifted out in eight steps.
OP12_SQL = """
WITH crc AS (SELECT doc_id, text, lang, source, CASE WHEN doc_id IS NULL THEN 15 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) % 16 END AS m FROM documents),
n AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS key, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
  CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM crc WHERE m <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM crc WHERE m = 5),
o AS (SELECT doc_id AS key, text, lang, source FROM crc),
ns AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS sha FROM n),
nr AS (SELECT *, row_number() OVER () AS nid, row_number() OVER (PARTITION BY key ORDER BY sha) AS i FROM ns),
orr AS (SELECT *, row_number() OVER () AS oid, row_number() OVER (PARTITION BY key ORDER BY sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~'))) AS i FROM o),
k AS (SELECT nr.nid, orr.oid FROM nr JOIN orr ON nr.key IS NOT DISTINCT FROM orr.key AND nr.i = orr.i),
nl AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key, nid) AS j FROM nr WHERE nid NOT IN (SELECT nid FROM k)),
ol AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key, oid) AS j FROM orr WHERE oid NOT IN (SELECT oid FROM k)),
c AS (SELECT nl.nid, ol.oid FROM nl JOIN ol ON nl.text IS NOT DISTINCT FROM ol.text AND nl.j = ol.j),
p AS (SELECT nid, oid, true AS by_key FROM k UNION ALL SELECT nid, oid, false FROM c),
f AS (SELECT nr.key AS key, orr.key AS old_key, by_key, concat_ws(',', CASE WHEN nr.text IS DISTINCT FROM orr.text THEN 'text' END, CASE WHEN nr.lang IS DISTINCT FROM orr.lang THEN 'lang' END,
  CASE WHEN nr.source IS DISTINCT FROM orr.source THEN 'source' END) AS changed, nr.sha FROM p JOIN nr ON p.nid = nr.nid JOIN orr ON p.oid = orr.oid)
SELECT CAST(key AS BIGINT) AS key, CAST(old_key AS BIGINT) AS old_key, CASE WHEN NOT by_key THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, sha AS row_sha256 FROM f
UNION ALL SELECT key, NULL, 'insert', '', sha FROM nr WHERE nid NOT IN (SELECT nid FROM p)
UNION ALL SELECT key, key, 'delete', '', NULL FROM orr WHERE oid NOT IN (SELECT oid FROM p)
"""

OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, rid, unnest(pieces) AS piece FROM d),
v AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase FROM v, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
i AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN m ON c.lang = m.lang AND c.phrase = m.phrase WHERE m.longer IS NULL OR 100 * m.longer < 50 * c.a),
x AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM kept),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, fl.f AS l, fr.f AS r, CAST(CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS lowest FROM y),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE lowest = 1)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, t.score FROM t JOIN n ON t.lang = n.lang WHERE t.rank <= 2000
"""

ORACLES: dict[str, str] = {"op9_warc": OP9_SQL, "op11_mixing": OP11_SQL, "op12_snapshot_difference": OP12_SQL, "op13_collocations": OP13_SQL}
