"""Masking against a brute force over characters."""

import random

from pyspark.sql import functions as F

from palisade.operators.decide import analyze
from palisade.operators.masking import SPANS, mask, masked, merged, pattern_finder


def brute(text, spans):
    """(merged spans, masked text), character by character."""
    spans = [s for s in spans if s[1] > s[0]]
    owner, out, at = {}, [], 0
    groups = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if groups and a <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], b)
        else:
            groups.append([a, b, k])
    for g in groups:
        for i in range(g[0], g[1]):
            owner[i] = g
    while at < len(text):
        if at in owner:
            out.append(f"<{owner[at][2]}>")
            at = owner[at][1]
        else:
            out.append(text[at])
            at += 1
    return [tuple(g) for g in groups], "".join(out)


def test_union_and_replacement(spark):
    r, rows = random.Random(3), []
    for i in range(200):
        text = "".join(r.choice("aé𝒳 z") for _ in range(r.randint(0, 30)))
        spans = [tuple(sorted((r.randint(0, len(text)), r.randint(0, len(text))))) + (r.choice("PQ"),) for _ in range(r.randint(0, 6))]
        rows.append((i, text, [{"start": a, "end": b, "kind": k} for a, b, k in spans]))
    df = spark.createDataFrame(rows, f"i int, text string, spans {SPANS.simpleString()}")
    for row in df.select("i", merged(F.col("spans")).alias("m"), masked(F.col("text"), F.col("spans")).alias("t")).collect():
        groups, text = brute(rows[row["i"]][1], [tuple(s.values()) for s in rows[row["i"]][2]])
        assert [tuple(s) for s in row["m"]] == groups and row["t"] == text


def test_finders_and_failures(spark):
    df = spark.createDataFrame([("ask jo@x.io or 10.0.0.1",), ("plain",), ("",), (None,)], "text string").withColumn("masked", F.lit("clash"))
    load = pattern_finder({"EMAIL": r"[a-z]+@[a-z.]+[a-z]", "IP": r"\d+(?:\.\d+){3}", "DIGITS": r"\d+"})
    assert [r["masked"] for r in mask(df, load).collect()] == ["ask <EMAIL> or <IP>", "plain", "", None]

    def broken():
        raise RuntimeError("no model")

    assert {r["masked"] for r in mask(df, broken).collect()} == {None}
    before = analyze(df).select("analysis").collect()
    assert analyze(mask(df, load)).select("analysis").collect() == before
