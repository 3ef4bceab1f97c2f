"""Ranks by histograms, running sums in two levels, and the knapsack of bars, against plain algorithms."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import evaluate, thresholds
from palisade.policies import LABELS


def test_nth_largest(spark):
    r = random.Random(1)
    for values in (
        [], [0.5], [0.7] * 40, [r.random() for _ in range(500)], [round(r.random(), 1) for _ in range(300)], [1 - 2.0**-k for k in range(52)] * 2,
        [math.nextafter(0.9, 1), 0.9, 0.9, math.nextafter(0.9, 0)], [5e-324, 0.0, 1e-323], [-1.0, 0.0, 2.5, 2.5],
    ):
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
        ordered = sorted(values, reverse=True)
        for n in {0, 1, 3, len(values) // 2, len(values) - 1, len(values)}:
            if n >= 0:
                assert thresholds.nth_largest(df, "v", n, bins=7) == (ordered[n] if n < len(ordered) else None)


def test_single_threshold_sorts_nothing_in_one_task(spark):
    rows = [("allowed", [0.1, i / 1000, *[0.0] * 5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "label string, scores array<double>")
    assert evaluate.single_threshold(df, 0.1) == pytest.approx(0.899 + 1e-6)
    assert evaluate.single_threshold(df.limit(0), 0.1) == 0.5
    assert evaluate.single_threshold(df.where("scores[1] < 0.05"), 0.1) == 0.5  # an empty tail


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(g, i / 3000 + 0.0, r.randint(0, 3), r.randint(0, 2)) for g in "ab" for i in r.sample(range(3000), 400)]
    got = thresholds.running_sums(spark.createDataFrame(rows, "g string, x double, p long, q long"), "g", "x", ["p", "q"], cuts=16)
    for row in got.collect():
        above = [s for s in rows if s[0] == row["g"] and s[1] >= row["x"]]
        assert (row["p"], row["q"]) == (sum(s[2] for s in above), sum(s[3] for s in above))
    assert got.count() == len(rows)


def plain_knapsack(options, budget):
    best = {0: (0.0, {})}
    for name, own in options.items():
        after = {}
        for cost, gain, bar in sorted(own):
            for spent, (value, bars) in sorted(best.items()):
                total = spent + cost
                if total <= budget and (total not in after or value + gain > after[total][0]):
                    after[total] = (value + gain, {**bars, name: bar})
        best = after
    return min(best.items(), key=lambda kv: (-kv[1][0], kv[0]))[1][1]


def test_best_choice_is_the_plain_one(spark):
    r = random.Random(3)
    for _ in range(300):
        options = {}
        for name in "abcd":
            costs = sorted(r.sample(range(1, 30), r.randint(0, 8)))
            gains = sorted(r.choice([0.125, 0.25, 0.5, 0.0625, 0.75]) + (r.randint(0, 4) / 16) for _ in costs)
            options[name] = [(0, 0.0, 1.0), *[(c, g, 1 - c / 100) for c, g in zip(costs, gains)]]
        budget = r.randint(0, 60)
        assert thresholds.best_choice(options, budget) == plain_knapsack(options, budget)


def test_a_budget_of_ten_million(spark):
    r = np.random.default_rng(4)
    options = {}
    for name in LABELS[1:]:
        cost = np.unique(r.integers(1, 10_000_000, 20_000))
        gain = np.sort(r.random(len(cost))) ** 2
        options[name] = [(0, 0.0, 1.0), *zip(cost.tolist(), gain.tolist(), (1 - cost / 1e9).tolist())]
    start = time.perf_counter()
    bars = thresholds.best_choice(options, 10_000_000)
    assert time.perf_counter() - start < 60
    picked = {n: next(o for o in options[n] if o[2] == bars[n]) for n in options}
    assert sum(o[0] for o in picked.values()) <= 10_000_000
    assert sum(o[1] for o in picked.values()) >= thresholds._reached({n: [(c, g) for c, g, _ in own] for n, own in options.items()}, 10_000_000)


def test_promising_rows_hold_the_best_choice(spark):
    r, rows = random.Random(6), []
    for name in LABELS[1:4]:
        fp = tp = 0
        for i in range(400):
            fp, tp = fp + r.randint(0, 3), tp + r.randint(1, 5)
            rows.append((name, fp, tp, 1 - i / 1000))
    sizes = {n: 3000 for n in LABELS[1:4]}
    front = spark.createDataFrame(rows, "winner string, fp long, tp long, score double")
    kept = thresholds.promising(thresholds.frontier(front), sizes, 300, buckets=16).collect()
    whole = {n: [(0, 0.0, 1.0), *[(f, t / 3000, s) for w, f, t, s in rows if w == n]] for n in sizes}
    few = {n: [(0, 0.0, 1.0), *[(k["fp"], k["gain"], k["score"]) for k in kept if k["winner"] == n]] for n in sizes}
    assert 0 < len(kept) < len(rows)
    gain = lambda bars: sum(next(o[1] for o in whole[n] if o[2] == b) for n, b in bars.items())
    assert gain(thresholds.best_choice(few, 300)) == pytest.approx(gain(plain_knapsack(whole, 300)))
