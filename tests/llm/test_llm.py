"""The training-data operators against brute force, and their edge cases: nulls, empty texts and tables, ties, clashes."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import common, cotraining, decontamination, html_text, line_dedup, lm, mixing, near_duplicates, packing, quality_rules, toxicity
from palisade.llm.shingles import shingle_sets, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "su", "té", "ro") for b in ("ra", "ti", "no", "ß", "un", "el")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.05 else "") for _ in range(n)).replace(". ", ".\n")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(60 + i, i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100 + i, rows[i][1], "de", "s1", 1) for i in range(4)]  # exact copies
    rows += [(200 + i, rows[i][1] + " extra tail", "de", None, None) for i in range(4)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \n\t ", "en", "s0", 3), (303, "two words", "en", "s2", 9), (304, "two words", "en", "s2", 9), (None, "no id here at all", "en", "s1", 1)]
    rows += [rows[5], rows[5], (400, "\n".join(prose(300, 900 + i) for i in range(30)), "en", "s0", 1), (401, "x " * 3000, "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("N_WORDS", F.lit("clash")).withColumn("kept", F.lit(7)).withColumn("score", F.lit(None).cast("string")).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (1, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t, lower=True):
    return (t or "").encode().translate(common.LOWER if lower else None).split()


def test_word_hashes_are_consistent():
    texts = [None, "", "a b", "B  a\nA", "é" * 9 + " x", "a b c d e f"]
    h, at = word_hashes(texts)
    flat = [w for t in texts for w in words(t)]
    assert list(np.diff(at)) == [len(words(t)) for t in texts]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    assert [len(s) for s in shingle_sets(texts)] == [0, 0, 1, 1, 1, 2]


def test_quality_rules(spark, docs, labels, empty):
    out = quality_rules.quality_rules(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and [c for c in out.columns if c.lower() == "kept"] == ["kept"] and "lang" in out.columns

    def base(t):
        w, lines = words(t, lower=False), [x for x in (t or "").split("\n") if x.split()]
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == base(r["text"])
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= -0.5)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert {r["llr"] for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def test_quality_ratio_brute_force(spark, docs, labels):
    import xxhash

    buckets = 64
    model = quality_rules.fit(docs, labels, buckets=buckets)
    other = quality_rules.fit(docs, labels, buckets=buckets, broadcast_rows=0)
    assert model == pytest.approx(other)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda w: signed(xxhash.xxh64_intdigest(w, seed=42))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42)))

    def bins(t):
        h = [one(w) for w in words(t, lower=False)]
        return [x % buckets for x in h + [pair(a, b) for a, b in zip(h, h[1:])]]

    good = {r[0] for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for r in docs.collect():
        raw.update(bins(r["text"]))
        if r["doc_id"] in good and r["doc_id"] is not None:
            target.update(bins(r["text"]))
    want = [math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in range(buckets)]
    assert model == pytest.approx(want)


def test_line_dedup(spark, empty):
    rows = [(i, f"own {i}\nshared line\n\n{'five' if i < 5 else 'nine'} sites", "en", f"s{i}" if i else None, 1) for i in range(9)] + [(20, None, "en", "s1", 1), (21, "", "en", "s1", 1), (22, "shared line", "en", "s2", 1), (22, "shared line", "en", "s2", 1), (23, "shared line\nx", "en", "s2", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("N_LINES", F.lit(1))
    for broadcast_rows in (0, 100):
        out = {(r["doc_id"], r["clean_text"]) for r in line_dedup.drop_boilerplate(df, min_sites=5, broadcast_rows=broadcast_rows).collect()}
        assert (0, "own 0\n") in out and (8, "own 8\n\nnine sites") in out and (20, None) in out and (21, "") in out and (22, "") in out and (23, "x") in out
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_decontamination(spark, docs, empty):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    w = text[7].split()
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[10:14]).upper()), (3, "two words"), (3, "two words"), (4, None), (5, ""), (6, "never " * 20), (None, " ".join(text[8].split()[:13])), (9, " ".join(w[5:18]))]
    table = spark.createDataFrame(items, "item_id long, text string")

    def brute(t):
        d = common.alnum_words_of(t)
        hit, ids = set(), set()
        for key, it in items:
            x = common.alnum_words_of(it)
            for win in {tuple(x[i : i + 13]) for i in range(max(1, len(x) - 12))} if x else ():
                for i in range(len(d) - len(win) + 1):
                    if tuple(d[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        ids.add("" if key is None else str(key))
        return len(d), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(d)

    for block in (10, 2_000_000):
        rows = decontamination.decontaminate(docs, table, block_words=block).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(r["text"])
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, table.limit(0)).collect())
    assert decontamination.decontaminate(empty, table).count() == 0


def test_decontamination_many_items_of_one_text(spark):
    """Items of one word cost their number plus the word's occurrences, not the product."""
    items = spark.createDataFrame([(i, "the") for i in range(2000)], "item_id long, text string")
    df = spark.createDataFrame([(1, "the " * 20_000), (2, "other words")], "doc_id long, text string").withColumn("Spans", F.lit(1)).withColumn("items", F.lit(2))
    found = {r["doc_id"]: r for r in decontamination.decontaminate(df, items).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"], found[1]["contaminated"]) == (20_000, 2000, True) and not found[2]["contaminated"]


def test_segments_brute_force():
    r = random.Random(1)
    for _ in range(60):
        s = np.array([r.uniform(-2, 2) for _ in range(r.randrange(0, 14))])
        got = toxicity.segments(s)

        def best(a, b):  # recursive definition: the highest-scoring contiguous run, then left and right of it
            runs = [(float(s[i:j].sum()), -i, -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not runs or max(runs)[0] <= 0:
                return []
            top = max(x[0] for x in runs)
            i, j = max(((j - i), -i, i, j) for v, _, _, i, j in runs if v == top)[2:]
            return best(a, i) + [top] + best(j, b)

        assert sum(x[2] for x in got) == pytest.approx(sum(best(0, len(s))))
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:])) and all(v == pytest.approx(float(s[a:b].sum())) for a, b, v in got)


def test_toxicity(spark, docs, empty, labels):
    bad = ["glorp", "snarfel", "snarfing"]
    rows = [(i, prose(50, i) + (f" {bad[i % 3]} {bad[(i + 1) % 3]} " if i % 4 == 0 else " ") + prose(20, i + 5000), "en", "s", 1) for i in range(240)]
    df = spark.createDataFrame(rows + [(999, None, "en", "s", 1), (998, "", "en", "s", 1)], DOCS)
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (i in held) for i in range(240))
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[999]["predicted"] == 0 == out[998]["predicted"]
    assert any(p["start"] <= 51 <= p["end"] + 1 for p in out[0]["passages"])
    assert toxicity.toxicity(empty, lab).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_near_duplicates(spark, docs, empty):
    rows = near_duplicates.near_duplicates(docs).collect()
    sets = []
    for r in docs.collect():
        w = words(r["text"])
        sets.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        k = find(i)
        least[k] = min(least.get(k, 1 << 60), key if key is not None else 1 << 60)
    want = Counter((key, len(s), key if key is None and least[find(i)] == 1 << 60 else least[find(i)]) for i, (key, s) in enumerate(sets))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    left = near_duplicates.without_duplicates(docs)
    assert left.columns == docs.columns
    kept = Counter(r["doc_id"] for r in left.collect())
    assert kept[5] == 1 and kept[100] == 0 and kept[200] == 0 and kept[0] == 1 and kept[300] == 1 and kept[302] == 1 and kept[304] == 0
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_without_duplicates_null_and_repeated_ids(spark):
    """Rows of one id, or of none, stand or fall by their own texts; of each component one row stays."""
    a, b, c, d, e, f, g = (prose(60, 700 + i) for i in range(7))
    near = e + " extra tail"
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, a), (None, e), (None, near), (3, f), (3, g), (3, g), (4, None), (4, ""), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    for broadcast_rows in (1_000_000, 0):
        left = Counter((r["doc_id"], r["text"]) for r in near_duplicates.without_duplicates(df, broadcast_rows=broadcast_rows).collect())
        assert left[None, e] + left[None, near] == 1
        del left[None, e], left[None, near]
        assert +left == Counter([(1, a), (None, b), (None, c), (2, d), (3, f), (3, g), (4, None), (4, ""), (None, None), (None, None)])


def test_near_duplicate_family(spark):
    """A family of edited copies: links only between some of them, found whatever the leaders are."""
    base = prose(200, 77).split()
    rows = []
    for i in range(60):
        r, w = random.Random(i), list(base)
        for _ in range(r.choice([1, 3, 5, 8])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets}


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in near_duplicates.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_html():
    long = "Many words in a row make a paragraph with some weight here. " * 3
    e = html_text.extract
    assert e(None) == e("") == e("<div></div>") == ""
    assert e("plain &amp; <b>bold</b>x") == "plain & boldx"
    assert e(f"<nav>n</nav><article><h1>T</h1><p>a&nbsp; b<p>c<br>d</article><footer>f</footer>") == "T\na b\nc\nd"
    assert e(f"<div id=header>h</div><div class=post><p>{long}</p><div class='ad box'>buy</div><p>tail</p></div><div class='comments'>{long * 3}</div>") == f"{long.strip()}\ntail"
    assert e(f"<main><article><p>{long}</p></article></main><aside>{long * 2}</aside><script>var t='</p>'</script>") == long.strip()
    assert e("<article>x<section class=comments><article class=comment>no</article></section></article>") == "x"
    assert e(f"<div class=sidebar><p>{long}</p></div>") == long.strip()
    assert e("<p>1 < 2 &lt;b&gt;</p>") == "1 < 2 <b>"


def test_html_noise_inside_the_article():
    """Without article or main: noise in an article doesn't end it, and its short lines belong to it."""
    e, ad = html_text.extract, "<div class=ad><p>x</p><p>y</p><p>z</p></div>"
    a, b, c = ("First words. " * 9).strip(), ("Second words. " * 7).strip(), ("Third words. " * 8).strip()
    assert e(f"<div class=post><p>{a}</p>{ad}<p>{b}</p></div>") == f"{a}\n{b}"
    assert e(f"<div class=post><p>{a}</p>{ad}<p>{b}</p>{ad}<p>The end.</p></div><div class=x><p>other</p></div>") == f"{a}\n{b}\nThe end."
    assert e(f"<div class=post><h1>Title</h1><p>By me</p><p>1 May</p><p>News</p><p>{a}</p></div>") == f"Title\nBy me\n1 May\nNews\n{a}"
    assert e(f"<body><p>menu</p><h1>Title</h1><p>By me</p><p>1 May</p><p>{a}</p>{ad}<p>{b}</p></body>") == f"Title\nBy me\n1 May\n{a}\n{b}"
    assert e(f"<h2>Title</h2><div class=post><div>{a}</div>{ad}<div>{b}</div></div>{ad}<div class=x><p>other</p><p>more</p></div>") == f"Title\n{a}\n{b}"
    assert e(f"<div id=w><section><h2>A</h2><p>{a}</p></section>{ad}<section><h2>B</h2><p>{b}</p></section>{ad}<div><p>o</p><p>p</p></div></div>") == f"A\n{a}\nB\n{b}"
    assert e(f"<div><article><p>{a}</p></article>{ad}<article><p>{b}</p></article><p>{c}</p><p>{c}</p></div><div><p>o</p><p>p</p></div>") == f"{a}\n{b}\n{c}\n{c}"


def test_html_stray_quotes_and_long_pages():
    e, ad = html_text.extract, "<div class=ad><p>x</p><p>y</p><p>z</p></div>"
    assert e('<p class="a"">Hello') == "Hello"
    assert e("""<p title='a>b' class="c>d">Hello <b id=x"y>there</b></p>""") == "Hello there"
    many = [f"Paragraph {i} with quite some words in it, and then as many again to make it a long line of text." for i in range(5_000)]
    assert e("<div class=post>" + ad.join(f"<p>{p}</p>" for p in many) + "</div>" + "<p>x" * 3) == "\n".join(many)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "<p>x</p>", 6), (2, "<p>x</p>", 6)], "page_id long, html string, Text int")
    out = html_text.main_text(df)
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_best_fit():
    r = random.Random(2)
    for _ in range(40):
        lengths = [r.randrange(1, 21) for _ in range(r.randrange(0, 40))]
        got = packing.best_fit_decreasing(lengths, 20)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        bins: list[list[int]] = []
        for n in sorted(lengths, reverse=True):  # the plain algorithm
            room = [b for b in bins if sum(b) + n <= 20]
            if room:
                max(room, key=sum).append(n)
            else:
                bins.append([n])
        assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(map(sum, bins))


def test_tokens_equal_the_tokenizer():
    t = packing.Tokens(keep=5)
    texts = ["Hello, world's best", "a  b\n\n c\t\td ", " x", "\x1c a\x1f b", "héé ￿ <|endoftext|> 12ab", "", "\n", "a  b \xa0c"]
    for text in texts * 2:
        assert list(t.encode(text)[:-1]) == t.encoding.encode_ordinary(text)


def test_tokens_of_columns_of_new_words(monkeypatch):
    """Many new words take few calls, and no cut of a text changes its ids."""
    r = random.Random(5)
    t = packing.Tokens(keep=700)
    whole, calls = t.encoding.encode_ordinary, []
    parts = [" ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "the", "of", "word,", "é", "中", "'s", "12", "."]
    texts = [None, "", " ", "a ", "  a", *["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(2000)]]
    for column in (texts, [None] * 3, []):
        got = t.encode_all(pa.array(["x  y", *column], pa.string()).slice(1))
        assert [g.tolist() for g in got] == [[*whole(x or ""), packing.END] for x in column]
    new = " ".join("".join(r.choice("abdeorst") for _ in range(9)) for _ in range(5000))
    monkeypatch.setattr(type(t.encoding), "encode_ordinary", lambda self, text: calls.append(text) or whole(text))
    assert t.encode(new).tolist() == [*whole(new), packing.END] and len(calls) < 20


def test_packing_round_trip(spark, docs, empty):
    rows = packing.pack(docs, length=128, block_tokens=2000).collect()
    t, parts = packing.Tokens(), Counter()
    found: dict = {}
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == len(places) == 128 and cu[-1] == r["n_tokens"] <= 128
        for key, off, a, b in zip(r["doc_ids"], r["offsets"], cu, cu[1:]):
            assert list(places[a:b]) == list(range(b - a))
            found.setdefault(key, []).append((off, ids[a:b].tolist()))
            parts[key] += 1
    want: dict = {}
    for r in docs.collect():
        ids = t.encode(r["text"]).tolist()
        want.setdefault(r["doc_id"], []).extend((a, ids[a : a + 128]) for a in range(0, len(ids), 128))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(empty).count() == 0


def test_packing_text_ids(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three"), ("a", "one two")], "doc_id string, text string")
    rows = packing.pack(df, length=64).collect()
    assert sorted(str(i) for r in rows for i in r["doc_ids"]) == ["None", "a", "a"]


def test_cotraining(spark, docs, empty):
    rows = [(i, prose(60, i) if i % 5 else " ".join(w + "###" for w in prose(60, i).split()), "en", "s1" if i % 5 else "s2", 1) for i in range(300)]
    df = spark.createDataFrame(rows + [(900, None, None, None, None), (901, "", "en", "s1", 0)], DOCS).withColumn("KEPT", F.lit(1))
    lab = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(150)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in cotraining.classify(df, lab).collect()}
    assert len(out) == 302
    assert np.mean([out[i]["kept"] == bool(i % 5) for i in range(150, 300)]) > 0.97
    again = {r["doc_id"]: r["quality_score"] for r in cotraining.classify(df, lab).collect()}
    assert again == {k: r["quality_score"] for k, r in out.items()}
    assert {r["quality_score"] for r in cotraining.classify(docs, lab.limit(0)).collect()} == {0.5}
    # repeated rows, an id on several texts, and very long texts change nothing for the others
    more = df.unionByName(df.where("doc_id between 200 and 220")).unionByName(spark.createDataFrame([(7, prose(200_000, 1), "en", "s1", 1), (299, "x", "en", "s1", 1)], DOCS).withColumn("KEPT", F.lit(1)))
    rows = cotraining.classify(more, lab).collect()
    assert len(rows) == 302 + 21 + 2 and np.mean([r["kept"] == bool(r["doc_id"] % 5) for r in rows if 150 <= r["doc_id"] < 299]) > 0.97
    assert cotraining.classify(empty, lab).count() == 0


def test_mixing(spark, docs, empty):
    from palisade.llm.queries import op9_mixing  # noqa: F401

    rows = mixing.fair_queue(docs, bucket_rows=2).collect()
    size = {(r["doc_id"]): len(words(r["text"])) for r in docs.collect()}
    assert all(r["size"] == size[r["doc_id"]] and r["copies"] in (0, 1, 2) for r in rows) and len(rows) == docs.count()
    sources = {r["source"]: r for r in rows}
    order = sorted(s for s in sources if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, budget = set(order), {}, 1.5 * sum(r["size"] for r in rows)
    rest = budget
    while True:  # reshare until nothing is above its cap
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > 2 * sources[s]["source_size"]}
        if not over:
            target |= {s: rest * weight[s] / total for s in left}
            break
        target |= {s: 2.0 * sources[s]["source_size"] for s in over}
        rest -= sum(target[s] for s in over)
        left -= over
    largest = max(size.values())
    for s in order:
        assert sources[s]["target"] == pytest.approx(target[s])
        taken = sum(r["size"] * r["copies"] for r in rows if r["source"] == s)
        assert abs(taken - target[s]) <= 2 * largest
    assert sum(r["size"] * r["copies"] for r in rows) <= budget
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter({r["doc_id"]: 0 for r in rows})
    for r in rows:
        want[r["doc_id"]] += r["copies"]
    assert +Counter(r["doc_id"] for r in out.collect()) == +want
    assert mixing.fair_queue(empty).count() == 0 == mixing.mixed(empty).count()
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["copies"] for r in mixing.fair_queue(nothing).collect()} == {0}


def test_mixing_targets_with_several_sources_that_are_not_filled(spark):
    """The contract's resharing, round by round, where more than one source stays under its cap."""
    r = random.Random(5)
    cases = [{"a": 100, "b": 100, "c": 100}, *[{f"s{i}": r.choice([0, 9, 500 + r.randrange(500), 500 + r.randrange(500)]) for i in range(n)} for n in (9, 20)]]
    for case in cases:
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(case))}
        left, want, rest = set(case), {}, 1.5 * sum(case.values())
        while over := {s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 2 * case[s]}:
            want |= {s: 2.0 * case[s] for s in over}
            rest -= sum(want[s] for s in over)
            left -= over
        want |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        got = mixing.source_targets(spark.createDataFrame(list(case.items()), "source string, size long")).collect()
        assert len(left) > 1 and {x["source"]: x["target"] for x in got} == pytest.approx(want)


def test_mixing_cuts_between_rows_of_one_id(spark):
    """Rows of no id or of one id are taken one by one, in the stage as in the queue, also where texts are equal."""
    r = random.Random(8)
    rows = [(None if i % 2 else 5, prose(10 + i % 7, 300 + i), f"s{i % 3}") for i in range(120)]
    same = [(5, prose(20, 77), f"s{i % 3}") for i in range(90)]
    few = [(i, prose(r.randrange(5, 30), i), f"s{i % 3}") for i in range(30)]
    for table in (rows + few, same, same + few, rows + same):
        df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in table], DOCS).repartition(3)
        size = {t: len(words(t)) for _, t, _ in table}
        queue = mixing.fair_queue(df).collect()
        want, got = Counter(), Counter()
        for q in queue:
            want[q["source"], q["doc_id"], q["size"]] += q["copies"]
        out = mixing.mixed(df)
        for q in out.collect():
            got[q["source"], q["doc_id"], size[q["text"]]] += 1
        assert out.columns == df.columns and got == +want
        assert sum(n * k[2] for k, n in got.items()) <= 1.5 * sum(len(words(t)) for _, t, _ in table)


def test_language_model(spark, docs, empty):
    rows = lm.lm_scores(docs, carry=["doc_id", "text"]).collect()
    other = lm.lm_scores(docs, carry=["doc_id", "text"], broadcast_types=0).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
    for a, b in zip(sorted(rows, key=key), sorted(other, key=key), strict=True):
        assert a["n_known"] == b["n_known"] and a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])
    count = Counter()
    held = lambda r: zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2
    for r in rows:
        if not held(r):
            count.update([*words(r["text"]), b""])
    n, v = sum(count.values()), len(count)
    for r in rows:
        t = [*words(r["text"]), b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r), len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert lm.lm_scores(empty).count() == 0


def test_language_model_probability_brute_force(spark, docs):
    """The score of a text from the model's table, one step and one feature at a time; and all slots of a position have a total of 1."""
    train = docs.select("text")
    model = lm.fit(train, rounds=1)
    count = {r["h"]: r["n"] for r in model.counts.collect()}
    some = spark.createDataFrame([(i, prose(12, 40 + i) + " unseen") for i in range(3)] + [(9, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(some, model).collect()}
    table = model.weights.astype(float)

    def softmax(rows):
        x = [sum(table[r][j] for r in rows) for j in range(lm.WIDTH)]
        top = max(x)
        return [math.exp(v - top) / sum(math.exp(u - top) for u in x) for v in x]

    for key, text in some.collect():
        keys, _, features, _ = lm.tokens([text])
        want = 0.0
        for i, k in enumerate(keys.tolist()):
            c, s = k & 255, (k >> 8) & 15
            for step, taken in enumerate((c >> 4, c & 15, s)):
                place = (0, 1 + (c >> 4), 17 + c)[step]
                rows = [((int(f) ^ int(lm._PATHS[place])) * int(lm._ODD) % (1 << 64)) >> (64 - lm.BITS) for f in features[: lm.KINDS[step], i]]
                want += math.log10(softmax(rows)[taken])
            here = [x for x in count if (x & 255, (x >> 8) & 15) == (c, s)]
            want += math.log10((count.get(k, 0) + 1) / (sum(count[x] for x in here) + len(here) + 1))
        assert got[key] == pytest.approx(want, rel=1e-4)
    # over all 256 x 16 slots of one position
    every = (np.arange(lm.LEAVES, dtype=np.int64) // 16) | ((np.arange(lm.LEAVES, dtype=np.int64) % 16) << 8)
    _, _, features, _ = lm.tokens([prose(5, 1)])
    logs = lm.path_logs(model.weights, every, np.repeat(features[:, 3:4], lm.LEAVES, axis=1))
    assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-3)


def test_language_model_learns_what_follows(spark):
    """Held-out texts of fixed successions score far above the shares of their words."""
    r = random.Random(5)
    follow = {w: r.choice(VOCAB) for w in VOCAB}

    def chain(n):
        out = [r.choice(VOCAB)]
        while len(out) < n:
            out.append(follow[out[-1]] if r.random() < 0.8 else r.choice(VOCAB))
        return " ".join(out)

    df = spark.createDataFrame([(i, chain(120)) for i in range(400)], "doc_id long, text string").repartition(2)
    rows = [x for x in lm.lm_scores(df).collect() if x["held_out"]]
    assert sum(x["score"] - x["base_score"] for x in rows) / sum(x["n_tokens"] for x in rows) > 0.25


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    state, ids = docs, {r[0] for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        state = common.staged(stage(spark, state, d), f"test-{number}")
        if number < 4:
            assert state.columns == docs.columns, name
            now = {r[0] for r in state.select("doc_id").collect()}
            assert now <= ids and len(now) > 0.5 * len(ids), name
            ids = now
    assert {i for r in state.collect() for i in r["doc_ids"]} == ids
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_columns_named_like_results(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    names = ["kept", "text_score", "Meta_Score", "quality_score", "n_words", "n_hit", "n_items", "items_sha256", "spans", "contaminated", "a.b"]
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontamination):
        out = stage(spark, docs, d)
        rows = out.collect()
        assert out.dtypes == docs.dtypes and rows
        assert all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)
