"""Exact calibration of thresholds on score tables of any size.

A rank is found by passes over histograms, not by a sort: each pass counts 4,096 equal bins and goes on inside the one that
holds the rank. Running sums over falling scores are taken in two levels, so that no task holds a label's scores. The best
bars for several labels under a shared budget of false blocks are a knapsack with one choice a label: Spark reduces each
label to the candidates that nothing dominates, drops those that can't be part of a best choice by bounds from a
coarse table of the candidates, and the driver merges what is left.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth_largest(rows: DataFrame, value: str, n: int, bins: int = 4096) -> float | None:
    """The value of rank n (from 0) in falling order, or None if there are no more than n. Nulls and NaNs don't count."""
    values = rows.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    first = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).head()
    if first["n"] <= n:
        return None
    low, high = first["low"], first["high"]
    while low < high:
        width = (high - low) / bins
        place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if width > 0 else (F.col("v") == high).cast("long")
        inside = values.where(F.col("v").between(low, high)).groupBy(place.alias("bin"))
        # at most `bins` rows
        for r in sorted(inside.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: -r["low"]):
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
    return low


def running_sums(rows: DataFrame, by: str, order: str, sums: list[str], cuts: int = 256) -> DataFrame:
    """Each row's sums of its group's rows down to it, in falling order of a number that is unique in its group.

    Groups are cut at approximate quantiles; a window never spans more than one cut's rows or the cuts' totals.
    """
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    edges = rows.groupBy(by).agg(F.percentile_approx(order, shares, 20_000).alias("__cuts"))
    # one row a group, of which there are as many as labels
    placed = rows.join(F.broadcast(edges), by).withColumn("__cut", F.size(F.filter("__cuts", lambda c: c > F.col(order)))).drop("__cuts")
    totals = placed.groupBy(by, "__cut").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    before = Window.partitionBy(by).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(by, "__cut", *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in sums])
    inside = Window.partitionBy(by, "__cut").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select(*[c for c in placed.columns if c not in sums], *[F.sum(s).over(inside).alias(s) for s in sums])
    return summed.join(F.broadcast(offsets), [by, "__cut"]).select(by, order, *[(F.col(s) + F.col(f"__{s}")).alias(s) for s in sums])


def candidates(won: DataFrame, budget: int, label: str) -> DataFrame:
    """For each winner and cost (fp, allowed rows blocked) within the budget, the most true positives and the score that has them.

    won: winner, best and the true label of rows that a bar could block.
    """
    tied = won.groupBy("winner", "best").agg(F.sum((F.col(label) == F.col("winner")).cast("long")).alias("tp"), F.sum((F.col(label) == "allowed").cast("long")).alias("fp"))
    summed = running_sums(tied, "winner", "best", ["tp", "fp"]).where(F.col("fp") <= budget)
    # of equal costs the highest true positives win, and of those the highest score
    return summed.groupBy("winner", "fp").agg(F.max(F.struct("tp", "best")).alias("m")).select("winner", "fp", F.col("m.tp").alias("tp"), F.col("m.best").alias("score"))


def frontier(found: DataFrame) -> DataFrame:
    """The candidates that none of equal or lower cost matches. Both sums grow along the scores, so the least cost of each tp is it."""
    least = found.groupBy("winner", "tp").agg(F.min(F.struct("fp", "score")).alias("m"))
    return least.select("winner", F.col("m.fp").alias("fp"), "tp", F.col("m.score").alias("score"))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The upper concave hull from (0, 0), by rising cost; it never falls."""
    best: dict[float, float] = {0.0: 0.0}
    for cost, gain in points:
        best[cost] = max(best.get(cost, 0.0), gain)
    hull: list[tuple[float, float]] = []
    for x, y in sorted(best.items()):
        if hull and y <= hull[-1][1]:
            continue
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) <= (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        hull.append((x, y))
    return hull


class _Bound:
    """The most that some labels can gain together within a cost: their hulls' steps, steepest first."""

    def __init__(self, hulls: list[list[tuple[float, float]]]):
        steps = sorted(((b[1] - a[1]) / (b[0] - a[0]), b[0] - a[0], b[1] - a[1]) for h in hulls for a, b in zip(h, h[1:]))[::-1]
        self.costs = np.cumsum([0.0, *[s[1] for s in steps]])
        self.gains = np.cumsum([sum(h[0][1] for h in hulls), *[s[2] for s in steps]])

    def __call__(self, cost: np.ndarray) -> np.ndarray:
        return np.interp(cost, self.costs, self.gains)

    def lines(self, most: int = 64) -> list[tuple[float, float]]:
        """(slope, height at 0) of lines above it; their least is a bound, too."""
        n = len(self.costs) - 1
        picked = sorted({round(i * (n - 1) / max(1, most - 1)) for i in range(most)}) if n else []
        slopes = [((self.gains[i + 1] - self.gains[i]) / (self.costs[i + 1] - self.costs[i]), i) for i in picked]
        return [(s, float(self.gains[i] - s * self.costs[i])) for s, i in slopes] + [(0.0, float(self.gains[-1]))]


def _reached(points: dict[str, list[tuple[int, float]]], budget: int) -> float:
    """What a greedy choice of real candidates gains: a bound from below."""
    steps, spent, now = [], 0, {}
    for name, own in points.items():
        hull = _hull([(c, g) for c, g in own])
        steps += [((b[1] - a[1]) / (b[0] - a[0]), name, b) for a, b in zip(hull, hull[1:])]
        now[name] = hull[0]
    for _, name, to in sorted(steps, key=lambda s: -s[0]):
        if spent + to[0] - now[name][0] <= budget:
            spent += to[0] - now[name][0]
            now[name] = to
    return sum(g for _, g in now.values())


_SLACK = 1e-9


def promising(front: DataFrame, sizes: dict[str, int], budget: int, buckets: int = 1024) -> DataFrame:
    """The frontier rows that may be part of a best choice, with gain (recall). At most `buckets` rows a label reach the driver."""
    size = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, float(max(n, 1)))]), F.col("winner")) if sizes else F.lit(1.0)
    gained = front.select("*", (F.col("tp") / size).alias("gain"))
    bucket = F.floor(F.col("fp") * buckets / (budget + 1))
    coarse = gained.groupBy("winner", bucket.alias("b")).agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.max("gain").alias("gain")).collect()
    names = sorted({r["winner"] for r in coarse})
    above = {n: _hull([(r["low"], r["gain"]) for r in coarse if r["winner"] == n]) for n in names}
    # tp rises with fp, so the dearest candidate of a bucket has its gain
    reached = _reached({n: [(r["high"], r["gain"]) for r in coarse if r["winner"] == n] for n in names}, budget)
    worth: Column = F.lit(False)
    for name in names:
        lines = _Bound([h for n, h in above.items() if n != name]).lines()
        rest = F.least(*[F.lit(y) + F.lit(s) * (budget - F.col("fp")) for s, y in lines], F.lit(math.inf))
        worth = worth | ((F.col("winner") == name) & (F.col("gain") + rest >= reached - _SLACK))
    return gained.where(worth)


def best_choice(options: dict[str, list[tuple[int, float, float]]], budget: int) -> dict[str, float]:
    """The bar of each label, from (cost, gain, bar) options, with the highest sum of gains within the budget.

    Of equal sums the cheapest wins, and then the one that spends less on later labels.
    """
    points = {name: [(c, g) for c, g, _ in own] for name, own in options.items()}
    hulls, reached = {n: _hull(p) for n, p in points.items()}, _reached(points, budget)
    names = list(options)
    cost, value, picks = np.zeros(1, dtype=np.int64), np.zeros(1), np.zeros((1, 0), dtype=np.int64)
    for i, name in enumerate(names):
        rest, others = _Bound([hulls[n] for n in names[i + 1 :]]), _Bound([hulls[n] for n in names if n != name])
        own = sorted(options[name])
        c, g = np.array([o[0] for o in own], dtype=np.int64), np.array([o[1] for o in own])
        live = np.flatnonzero((c <= budget) & (g + others(budget - c) >= reached - _SLACK))
        parts = []
        for k in live.tolist():
            total, gain = cost + c[k], value + g[k]
            fit = np.flatnonzero((total <= budget) & (gain + rest(budget - total) >= reached - _SLACK))
            parts.append((total[fit], gain[fit], np.full(len(fit), k), fit))
        total, gain, pick, was = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((pick, -gain, total))
        ahead = np.concatenate([[-np.inf], np.maximum.accumulate(gain[order])[:-1]])
        order = order[gain[order] > ahead]  # a state that costs more has to gain more
        cost, value = total[order], gain[order]
        picks = np.column_stack([picks[was[order]], pick[order]])
    best = int(np.argmax(value))
    return {name: sorted(options[name])[picks[best, i]][2] for i, name in enumerate(names)}
