"""Filter audit, best-two-fit packing and ranked search against brute force, with nulls, ties, repeats and clashes."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import filter_audit, ranked_search, two_fit

DOCS = "doc_id long, text string, lang string"
VOCAB = ["the", "of", "River", "stone", "LIGHT", "é", "naïve", "x1", "x2", "harbour", "moss", "ridge"]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB[: r.randint(2, len(VOCAB))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(20 + 13 * i, i), ["en", "de", None][i % 3]) for i in range(40)]
    out += [(100 + i, out[i][1], "de") for i in range(6)]  # copies
    out += [(i, out[i][1], "fr") for i in range(3)]  # copies of the same id
    out += [(200, None, "en"), (201, "", None), (202, " \n\t ", ""), (203, "a # b", "en"), (None, out[3][1], "en"), (None, out[3][1], "en"), (None, None, None)]
    out += [out[7], out[7], (300, "x" * 3000 + " the tail", "en"), (301, "the " * 9000, "en"), (302, "%&|", "en"), (303, "THE the", "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("N_WORDS", F.lit("clash")).withColumn("good", F.lit(7)).withColumn("piece", F.lit(1)).withColumn("block", F.lit("b")).withColumn("term", F.lit(None).cast("int")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_filter_audit(spark, docs, rows, empty):
    marks = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, 0, 1), (3, None, None), (100, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in marks if i is not None and q == 1}, {i for i, _, t in marks if i is not None and t == 1}
    least = defaultdict(lambda: math.inf)
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least[t or ""], i)

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return "".join(
            x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i)) if bad
        )

    expected = {}
    for part in {p or "" for _, _, p in rows}:
        own = [(fails(i, t), i in good, i in toxic) for i, t, p in rows if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                kept = sum(not set(f) & (before | {letter}) for f, _, _ in own)
                gone = [x for x in own if letter in x[0] and not set(x[0]) & before]
                redundant = sum(letter in f and bool(set(f) & before) for f, _, _ in own)
                shapley[letter] += len(gone)
                expected[part, "".join(order), step] = [kept, len(gone), redundant, sum(f == letter for f, _, _ in own), sum(g for _, g, _ in gone), sum(x for _, _, x in gone), letter]
        for key, value in expected.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.interactions(filter_audit.filter_flags(docs, labels)).collect()}
    assert got == expected
    assert filter_audit.interactions(filter_audit.filter_flags(empty, labels)).count() == 0
    flags = filter_audit.filter_flags(docs, labels.limit(0))
    assert flags.count() == len(rows) and flags.where("good or toxic").count() == 0
    assert {r["kept"] for r in filter_audit.interactions(flags.where("id = 203"), "AD").collect()} == {0}
    with pytest.raises(ValueError):
        filter_audit.interactions(flags, "ABCDEFG")


def one_by_one(lengths: list[int], room: int) -> list[list[int]]:
    """Best-two-fit without counts or patterns: a sequence at a time, from a plain list of pieces."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        members = []
        for n in list(left):
            if n <= room - sum(members):
                members.append(n)
                left.remove(n)
        while sum(members) < room and len(members) > 1:
            low = min(members)
            gap, pool = room - sum(members) + low, sorted([*left, low], reverse=True)
            pairs = [(pool[a] + pool[b], pool[a], pool[b]) for a in range(len(pool)) for b in range(a + 1, len(pool)) if pool[a] + pool[b] <= gap]
            if not pairs or max(pairs)[0] <= low:
                break
            _, x, y = max(pairs)
            members.remove(low)
            left = pool
            for n in (x, y):
                left.remove(n)
                members.append(n)
        out.append(sorted(members, reverse=True))
    return out


def test_patterns_are_best_two_fit():
    r = random.Random(5)
    for room, top, n in ((20, 20, 60), (50, 30, 80), (31, 12, 100), (64, 9, 50), (10, 10, 1), (12, 1, 30)):
        lengths = [r.randint(1, top) for _ in range(n)]
        patterns = two_fit.plan_sequences(Counter(lengths), room)
        plain = one_by_one(lengths, room)
        assert [sorted((n for n, u in m for _ in range(u)), reverse=True) for again, m in patterns for _ in range(again)] == plain
        assert Counter(n for s in plain for n in s) == Counter(lengths) and all(sum(s) <= room for s in plain)
    # exchanging helps: 6 leaves a gap of 4 that a 3 fills badly, and two 2s fill it
    assert two_fit.plan_sequences({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])
    assert two_fit.plan_sequences({}, 10) == []
    many = two_fit.plan_sequences({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(many) < 20_000 and sum(a for a, _ in many) <= 1 + 1.0001 * sum(n * (10**9 + n) for n in range(1, 2049)) / 2048


def test_cuts():
    assert two_fit.cuts(1, 4) == [(0, 1)] and two_fit.cuts(4, 4) == [(0, 4)]
    assert two_fit.cuts(9, 4) == [(0, 1), (1, 5), (5, 9)] and two_fit.cuts(8, 4) == [(0, 4), (4, 8)]


def test_ids_of_units_are_the_tokenizers():
    units = two_fit.UnitIds(keep=50)
    r = random.Random(8)
    alphabet = ["a", "B", "é", "'s", "'", " ", "  ", "\n", "\t", "\x1c", " ", " ", "​", "7", "!?", "中", "<|endoftext|>", "don't", "\r\n", "ſ", "\x85", "𝒳"]
    texts = ["", " ", None, "a" * 5000, *["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(400)]]
    for text in texts:
        whole = units.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(units.encode(text), "<u4").tolist() == whole, repr(text)


def test_best_two_fit(spark, docs, rows, empty):
    units, length = two_fit.UnitIds(), 64
    out = two_fit.pack_two_fit(docs, length=length, keep_ids=True).cache()
    got = out.collect()
    size = lambda t: len(units.encode(t)) // 4 + 1
    sizes = Counter(b - a for _, t, _ in rows for a, b in two_fit.cuts(size(t), length))
    assert Counter(r["length"] for r in got) == sizes
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert len(by) == sum(a for a, _ in two_fit.plan_sequences(sizes, length)) == len(one_by_one(list(sizes.elements()), length))
    assert len(by) <= 1.02 * sum(n * c for n, c in sizes.items()) / length + 1
    # every document is there whole, as often as its row
    texts = defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append((r["piece"], r["start"], bytes(r["ids"])))
    for i in {i for i, _, _ in rows}:
        whole = Counter(b for _, t, _ in [x for x in rows if x[0] == i] for a, b in [(0, units.encode(t) + b"\0\0\0\0")])
        assert sum(len(p[2]) for p in texts[i]) == sum(len(k) * n for k, n in whole.items())
        if sum(whole.values()) == 1:
            assert b"".join(p[2] for p in sorted(texts[i])) == next(iter(whole)) and [p[0] for p in sorted(texts[i])] == list(range(len(texts[i])))
    joined = two_fit.sequences(out).collect()
    assert len(joined) == len(by) and all(len(r["input_ids"]) == 4 * sum(r["lengths"]) for r in joined)
    assert two_fit.pack_two_fit(empty).count() == 0
    with pytest.raises(ValueError):
        two_fit.pack_two_fit(docs, length=40_000)


def ranking(docs, items, k):
    """The contract's formula, term by term, in Python's integers."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(pattern, t or "")]
    counted = [(i, Counter(terms(t))) for i, t, *_ in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text, *_ in items:
        asked, scores = Counter(terms(text)), []
        for i, c in counted:
            m = 75 + (25 * c.total() * n_docs) // max(total, 1)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"block_docs": 3}, {"block_docs": 5, "block_terms": 200}])
def test_ranked_search(spark, docs, rows, empty, options):
    items = [(1, "River of light, river!"), (2, "the"), (3, "unknown words only"), (4, None), (5, ""), (None, "naïve é harbour"), (7, "ridge x1 x2 THE ridge"), (7, "ridge x1 x2 THE ridge"), (8, "tail moss")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("place", F.lit(1)).withColumn("doc_id", F.lit("clash"))
    index = ranked_search.build_index(docs, **options)
    got = lambda *a, **b: sorted((tuple(r) for r in ranked_search.search(*a, **b).collect()), key=repr)
    for k in (1, 7, 20):
        assert got(index, asked, k=k) == ranking(rows, items, k)
    assert got(index, asked, k=5, block_terms=4) == ranking(rows, items, 5)
    assert got(ranked_search.build_index(empty), asked) == [] == got(index, asked.limit(0))


def test_bounds_hold():
    values = np.array([0, 1, 2, 3921, 3922, 3923, 123_456, 500_000, 999_998, 999_999], dtype=np.int64)
    byte = (values * 255 + 999_999) // 1_000_000
    assert (ranked_search._UPPER[byte] >= values).all() and (ranked_search._LOWER[byte] <= values).all() and byte.max() == 255
