"""Mixes, snapshot differences and phrases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("lokalis.llm")
from lokalis.llm import collocations, mixing, snapshot_diff  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, size long, part int, h string, rank int, gid int"


def docs_of(spark, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, 7, 7, "x", 7, 7) for i, t, lang, src in rows], SCHEMA)


EDGES = [(1, None, "en", "b"), (2, "", None, None), (3, " \n\t ", "de", "b"), (4, "one two", "en", None), (4, "one two", "en", None), (5, "x" * 200_000, "en", "a"), (None, "no id here", "en", "c"), (None, None, None, None), (6, "w " * 30_000, "fr", "a")]


# --- mixes


def brute_targets(rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, on = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while on:
        level = left / sum(weight[s] for s in on)
        over = [s for s in on if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in on}
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
            on.remove(s)
    return sizes, target


def mix_rows(n, seed):
    r = random.Random(seed)
    return [(k, " ".join("w" * r.randint(1, 3) for _ in range(int(r.paretovariate(1)) * 3)), "en", r.choice(["hot"] * 6 + ["a", "b", "c", "", None, "\U0001f600", "￿"])) for k in range(n)]


@pytest.mark.parametrize("rows", [EDGES, mix_rows(400, 1), mix_rows(60, 2) + [(9, "a b c", "en", "hot")] * 300], ids=["edges", "many", "copies"])
def test_mixed_words_reach_their_targets(spark, rows):
    sizes, target = brute_targets(rows)
    got = [tuple(x) for x in mixing.mixed_words(docs_of(spark, rows), block=32).collect()]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((i, n) for i, n, *_ in got) == Counter((i, words(t)) for i, t, _, _ in rows)
    assert all(0 <= taken <= 2 * n for _, n, _, _, taken in got)
    taken, told = defaultdict(int), {}
    by_row = defaultdict(set)
    for i, t, _, s in rows:
        by_row[i, words(t)].add(s)
    for i, n, of, aim, t in got:
        (s,) = by_row[i, n] if len(by_row[i, n]) == 1 else [next(s for s in by_row[i, n] if sizes[s] == of)]
        taken[s] += t
        told[s] = aim
        assert of == sizes[s]
    for s in sizes:
        assert abs(told[s] - float(target[s])) <= 1e-9 * max(1, target[s]) and abs(taken[s] - target[s]) <= Fraction(1, 2)
    again = [tuple(x) for x in mixing.mixed_words(docs_of(spark, rows[::-1]).repartition(3), block=32).collect()]
    assert Counter(again) == Counter(got)


def test_mix_spans_fill_slots_and_give_the_words(spark):
    rows = mix_rows(120, 3)
    docs = docs_of(spark, rows)
    spans = mixing.mix(docs, block=16)
    got = spans.collect()
    used = Counter()
    for x in got:
        used[x.doc_id] += x.n_words
    want = {x.doc_id: x.taken for x in mixing.mixed_words(docs, block=16).collect()}
    assert {k: v for k, v in want.items() if v} == dict(used)
    for slot in {x.slot for x in got}:  # a slot holds one source's words without gaps
        own = sorted((x.offset, x.n_words, x.source or "") for x in got if x.slot == slot)
        assert len({s for _, _, s in own}) == 1 and own[0][0] == 0 and sum(n for _, n, _ in own) <= 16
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    text = {(x.slot, x.offset): x.text for x in mixing.texts(spans, docs).collect()}
    by_id = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t, _, _ in rows}
    assert all(text[x.slot, x.offset] == " ".join(by_id[x.doc_id][x.first_word : x.first_word + x.n_words]) for x in got)


@pytest.mark.parametrize("quotas", [[5, 2, 1], [1000, 1, 1, 333], [1], [7] * 50, [0, 3, 0]])
def test_schedule_is_that_of_the_points(spark, quotas):
    sources = spark.createDataFrame([(k, q) for k, q in enumerate(quotas)], "place long, quota long")
    got = sorted((x.slot, x.place, x["rank"]) for x in mixing.schedule(sources).collect())
    n, whole = sum(quotas), 1 << mixing.DIGITS
    limits = [sum(quotas[:k]) * whole // n for k in range(len(quotas) + 1)]
    seen, want = Counter(), []
    for slot in range(n):
        point = int(f"{slot:0{mixing.DIGITS}b}"[::-1], 2)
        place = next(k for k in range(len(quotas)) if limits[k] <= point < limits[k + 1])
        if seen[place] < quotas[place]:
            want.append((slot, place, seen[place]))
        seen[place] += 1
    assert [x for x in got if x[0] < n] == want
    assert Counter(p for _, p, _ in got) == Counter({k: q for k, q in enumerate(quotas) if q}) and len({s for s, _, _ in got}) == n
    assert all({r for _, p, r in got if p == k} == set(range(q)) for k, q in enumerate(quotas))


def test_mixes_of_nothing(spark):
    assert mixing.mixed_words(docs_of(spark, [])).count() == 0 and mixing.mix(docs_of(spark, [])).count() == 0
    assert [tuple(x) for x in mixing.mixed_words(docs_of(spark, [(1, None, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


# --- snapshots


def sha(row):
    return hashlib.sha256("\n".join("~" if v is None else v for v in row).encode()).hexdigest()


def brute_difference(old, new):
    """Rows are (key, text, lang, source)."""
    out, left_old, left_new = [], [], []
    for key in {r[0] for r in old + new}:
        a, b = (sorted((r for r in side if r[0] == key), key=lambda r: sha(r[1:])) for side in (old, new))
        for x, y in zip(a, b):
            changed = ",".join(n for n, u, v in zip(("text", "lang", "source"), x[1:], y[1:]) if u != v)
            out.append((key, key, "update" if changed else "same", changed, sha(y[1:])))
        left_old += a[len(b) :]
        left_new += b[len(a) :]
    for text in {r[1] for r in left_old + left_new}:
        a, b = (sorted((r for r in side if r[1] == text), key=lambda r: (r[0] is not None, r[0] or 0)) for side in (left_old, left_new))
        for x, y in zip(a, b):
            out.append((y[0], x[0], "rekey", ",".join(n for n, u, v in zip(("text", "lang", "source"), x[1:], y[1:]) if u != v), sha(y[1:])))
        out += [(x[0], x[0], "delete", "", None) for x in a[len(b) :]] + [(y[0], None, "insert", "", sha(y[1:])) for y in b[len(a) :]]
    return Counter(out)


def snapshot_rows(n, seed, texts):
    r = random.Random(seed)
    return [(k, r.choice(texts), r.choice(["en", "de", None]), r.choice(["a", None])) for k in r.sample(range(3 * n), n)]


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("case", ["hot", "mixed", "edges"])
def test_differences_equal_brute_force(spark, parts, case):
    hot, varied = ["copied text"] * 6 + ["t1", "t2", None, ""], [f"text {k}" for k in range(40)] + [None, "~", "é\U0001f600"]
    old, new = {"hot": (snapshot_rows(300, 1, hot), snapshot_rows(280, 2, hot)), "mixed": (snapshot_rows(150, 3, varied), snapshot_rows(170, 4, varied)), "edges": ([(None, None, None, None), (1, "a", "en", "s"), (1, "a", "en", "s"), (1, "b", "en", "s"), (2, "x" * 100_000, None, "s")], [(1, "b", "en", "s"), (9, "a", "de", "s"), (None, None, None, "s"), (8, "x" * 100_000, None, None), (8, "x" * 100_000, None, None)])}[case]
    table = lambda rows: docs_of(spark, rows).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = snapshot_diff.difference(table(old), table(new), "doc_id", "text", ["text", "lang", "source"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(tuple(x) for x in got) == brute_difference(old, new)


def test_differences_of_nothing(spark):
    some, none = docs_of(spark, EDGES), docs_of(spark, [])
    run = lambda a, b: Counter(x.op for x in snapshot_diff.difference(a, b, "doc_id", "text", ["text"]).collect())
    assert run(none, none) == {} and run(some, none) == {"delete": len(EDGES)} and run(none, some) == {"insert": len(EDGES)} and run(some, some) == {"same": len(EDGES)}


def test_the_later_snapshot_follows_its_rule(spark):
    rows = [(k, None if k % 9 == 0 else f"t{k}", "en", "s") for k in range(200)] + [(None, "x", "en", "s")]
    want = []
    for k, t, lang, s in rows:
        m = 15 if k is None else zlib.crc32(str(k).encode()) % 16
        if m == 0:
            continue
        want.append({1: (k, (t or "") + "+", lang, s), 2: (k, t, s, lang), 3: (-1 - (k or 0), t, lang, s), 4: (-1 - (k or 0), t, lang, None)}.get(m, (k, t, lang, s)))
        if m == 5:
            want.append((-1 - k, t, lang, s))
    assert Counter(tuple(x) for x in snapshot_diff.later_snapshot(docs_of(spark, rows)).collect()) == Counter(want)


def test_ranks_do_not_depend_on_where_partitions_cut(spark):
    rows = [("g" if k % 3 else f"u{k}", k % 2, k, k) for k in range(500)]
    df = spark.createDataFrame([(g.encode(), *r) for g, *r in rows], "gid binary, side int, key long, salt long")
    seen, want = Counter(), {}
    for gid, side, key, _ in sorted(rows):
        seen[gid, side] += 1
        want[gid, side, key] = seen[gid, side]
    for parts in (1, 2, 7, 40):
        got, _ = snapshot_diff.ranked(df.repartition(5), ["key"], parts)
        assert {(bytes(x.gid).decode(), x.side, x.key): x["rank"] for x in got.collect()} == want


# --- phrases


def brute_collocations(rows, longest=3, least=10, share=50, best=2000):
    f = defaultdict(Counter)
    n = Counter()
    for _, text, lang, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if " " in p and a >= least}
        rows_of = []
        for p, a in found.items():
            if any(f" {p} " in f" {q} " and p != q and 100 * b >= share * a for q, b in found.items()):
                continue
            w = p.split(" ")
            cuts = [(1_000_000 * a * a // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k, counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
            s, _, left, right = min(cuts)
            rows_of.append((-s, -a, p.encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:best], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_texts(n, seed):
    r = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "a", "Été", "x1", "end\x00"]
    return [(k, "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(r.randint(0, 80))), r.choice(["en", "en", "de", None]), "s") for k in range(n)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_brute_force(spark, longest):
    rows = phrase_texts(150, longest) + EDGES
    want = brute_collocations(rows, longest)
    for parts in (1, 4):
        assert {tuple(x) for x in collocations.collocations(docs_of(spark, rows).repartition(parts), longest=longest).collect()} == want


@pytest.mark.parametrize("packed,block", [(32, 200_000), (4, 7), (1, 50), (100_000, 1000)])
def test_bitmaps_of_a_shard_equal_brute_force(monkeypatch, packed, block):
    monkeypatch.setattr(collocations, "PACKED", packed)
    monkeypatch.setattr(collocations, "BLOCK", block)
    r = random.Random(packed)
    word = np.array([r.choice([-1, 0, 0, 0, 1, 1, 2, 3, 4, 5, 6]) for _ in range(2000)])
    got = Counter()
    for ids, n in collocations.Shard(word, 7).found(4):
        for p, c in zip(ids.tolist(), n.tolist()):
            got[tuple(p)] += c
    want = Counter(tuple(w) for k in (1, 2, 3, 4) for i in range(len(word) - k + 1) if (w := word[i : i + k].tolist()) and -1 not in w)
    assert got == want


def test_few_best_and_ties_in_byte_order(spark):
    text = "\n".join(f"{a} {b}" for a, b in [("ab", "cd"), ("abé", "x"), ("abz", "y"), ("\U0001f600", "q"), ("￿", "q2")] for _ in range(12))
    got = [x.phrase for x in collocations.collocations(docs_of(spark, [(1, text, "en", "s")]), best=4).orderBy("rank").collect()]
    assert got == sorted(["ab cd", "abé x", "abz y", "\U0001f600 q", "￿ q2"], key=str.encode)[:4]


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10**14 - 1, 10**14, 10**14), (3_037_000_500, 3_037_000_501, 3_037_000_503), (10, 10, 10), (7, 9, 11)]
    got = [x[0] for x in spark.createDataFrame(cases, "a long, l long, r long").select(F.expr(collocations.SCORE)).collect()]
    assert got == [1_000_000 * a * a // (left * r) for a, left, r in cases]


def test_phrases_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0 and collocations.collocations(docs_of(spark, EDGES[:3])).count() == 0
