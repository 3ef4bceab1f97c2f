"""Hash-stable samples, threshold calibration and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policies import LABELS, UNAVAILABLE
from .thresholds import best_choice, candidates, frontier, nth_largest, promising

BLOCKED = LABELS[1:]


class CoverageError(ValueError):
    """Too many rows were left unmapped to train on what remains."""


def coverage_gate(unmapped: int, output: int) -> None:
    if unmapped > 1000 and unmapped > 0.01 * output:
        raise CoverageError(f"{unmapped} unmapped rows against {output}")


def bounded_sample(rows: DataFrame, caps: dict[str, int], default: int, *, label: str = "label", digest: str = "digest") -> DataFrame:
    """The rows of least digest of each label, at most its cap. Spark keeps only so many a task before its shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(digest))
    cap = F.lit(default)
    for name, n in caps.items():
        cap = F.when(F.col(label) == name, n).otherwise(cap)
    top = max([default, *caps.values()])
    return rows.withColumn("__r", rank).where((F.col("__r") <= top) & (F.col("__r") <= cap)).drop("__r")


def balanced_sample(rows: DataFrame, cap: int, *, labels: list[str] | None = None, label: str = "label", digest: str = "digest") -> DataFrame:
    """As many rows of each label as the rarest has (at most cap), those of least digest. A missing label is an error."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    wanted = labels or sorted(sizes)
    missing = [x for x in wanted if not sizes.get(x)]
    if missing:
        raise ValueError(f"no rows of {missing}")
    return bounded_sample(rows.where(F.col(label).isin(wanted)), {}, min(cap, *(sizes[x] for x in wanted)), label=label, digest=digest)


def leaked(splits: DataFrame, *, digest: str = "digest", split: str = "split") -> DataFrame:
    """Digests that more than one split has."""
    return splits.groupBy(digest).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def block_label(scores: Column, bar: Column) -> Column:
    """The winning blocked label if it beats both the allowed score and its bar, else null. bar: of the winner's place."""
    blocked = F.slice(scores, 2, len(BLOCKED))
    best = F.array_max(blocked)
    winner = F.array_position(blocked, best).cast("int")
    names = F.array(*[F.lit(b) for b in BLOCKED])
    return F.when((best > F.get(scores, F.lit(0))) & (best > F.element_at(bar, winner)), F.element_at(names, winner))


def _bars(threshold) -> Column:
    values = [threshold[b] for b in BLOCKED] if isinstance(threshold, dict) else [threshold] * len(BLOCKED)
    return F.array(*[F.lit(float(v)) for v in values])


def winners(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """Adds allowed, best and winner (the first label of the best blocked score)."""
    blocked = F.slice(F.col(scores), 2, len(BLOCKED))
    best = F.array_max(blocked)
    winner = F.element_at(F.array(*[F.lit(b) for b in BLOCKED]), F.array_position(blocked, best).cast("int"))
    return scored.withColumn("allowed", F.get(scores, F.lit(0))).withColumn("best", best).withColumn("winner", winner)


def single_threshold(scored: DataFrame, rate: float, *, label: str = "label") -> float:
    """The bar just above the allowed rows' tail: the element after the budget, in falling order; at least .5, at most 1."""
    won = winners(scored).where(F.col(label) == "allowed")
    budget = math.floor(won.count() * rate)
    tail = nth_largest(won.where("best > allowed"), "best", budget)
    return min(1.0, max(0.5, 0.5 if tail is None else tail + 1e-6))


def calibrated_metrics(scored: DataFrame, threshold, *, label: str = "label", scores: str = "scores") -> DataFrame:
    """One row: allowed_false_block_rate, blocked_recall, allowed_count, blocked_count."""
    hit = block_label(F.col(scores), _bars(threshold)).isNotNull()
    allowed = F.col(label) == "allowed"
    n = lambda c: F.sum(c.cast("long"))
    sums = scored.agg(n(allowed).alias("a"), n(~allowed).alias("b"), n(allowed & hit).alias("fa"), n(~allowed & hit).alias("tb"))
    rate = lambda x, y: F.coalesce(F.col(x), F.lit(0)) / F.greatest(F.coalesce(F.col(y), F.lit(0)), F.lit(1))
    return sums.select(rate("fa", "a").alias("allowed_false_block_rate"), rate("tb", "b").alias("blocked_recall"), F.coalesce("a", F.lit(0)).alias("allowed_count"), F.coalesce("b", F.lit(0)).alias("blocked_count"))


def class_candidates(scored: DataFrame, budget: int, floor: float = 0.9, *, label: str = "label") -> DataFrame:
    """For each winner and false-positive cost within budget, the most true positives and the score that has them."""
    return candidates(winners(scored).where((F.col("best") > F.col("allowed")) & (F.col("best") > floor)), budget, label)


def class_thresholds(scored: DataFrame, rate: float, floor: float = 0.9, *, label: str = "label") -> dict[str, float]:
    """A bar for each blocked label that has the best mean recall within a shared budget of false blocks.

    The candidates that may matter are found by Spark (see thresholds); merging them runs on the driver.
    """
    sizes = {r[0]: r[1] for r in scored.groupBy(label).count().collect() if r[0] is not None}
    budget = math.floor(sizes.get("allowed", 0) * rate)
    options: dict[str, list[tuple[int, float, float]]] = {b: [(0, 0.0, 1.0)] for b in BLOCKED}
    front = frontier(class_candidates(scored, budget, floor, label=label))
    for r in promising(front, {b: sizes.get(b, 0) for b in BLOCKED}, budget).collect():
        bar = math.nextafter(r["score"], -math.inf)
        if r["gain"] > 0:
            options[r["winner"]] = [o for o in options[r["winner"]] if o[0] != r["fp"]] + [(r["fp"], r["gain"], bar)]
    return best_choice(options, budget)


def argmax_metrics(scored: DataFrame, *, label: str = "label", scores: str = "scores") -> DataFrame:
    """Accuracy and recall of the label of the highest score, by true label; the row of all has a null label."""
    names = F.array(*[F.lit(x) for x in LABELS])
    guess = F.element_at(names, F.array_position(F.col(scores), F.array_max(scores)).cast("int"))
    hit = scored.select(F.col(label).alias("label"), (guess == F.col(label)).cast("long").alias("hit"))
    return hit.rollup("label").agg(F.count("*").alias("rows"), (F.sum("hit") / F.count("*")).alias("recall"))


def confusion(judged: DataFrame, *, blocked: str = "blocked", truth: str = "truth") -> DataFrame:
    """One row of confusion counts and rates of boolean columns."""
    b, t = F.col(blocked), F.col(truth)
    n = lambda c: F.sum(c.cast("long"))
    sums = judged.agg(n(b & t).alias("caught"), n(~b & t).alias("missed"), n(b & ~t).alias("false_blocks"), n(~b & ~t).alias("passed"))
    rate = lambda x, y: F.col(x) / F.greatest(F.col(x) + F.col(y), F.lit(1))
    return sums.withColumn("allowed_false_block_rate", rate("false_blocks", "passed")).withColumn("blocked_recall", rate("caught", "missed"))


def gateway_evaluation(baseline: DataFrame, combined: DataFrame | None = None, *, key: str = "id", label: str = "label", analysis: str = "analysis") -> DataFrame:
    """By true label: rows, caught by rules, and added by models (for rows that the rules let through)."""
    rules = baseline.select(key, label, (F.col(f"{analysis}.decision") == "BLOCKED").alias("rule"))
    if combined is None:
        both = rules.withColumn("model", F.lit(False))
    else:
        both = rules.join(combined.select(key, (F.col(f"{analysis}.decision") == "BLOCKED").alias("model")), key)
    n = lambda c: F.sum(c.cast("long"))
    return both.groupBy(label).agg(F.count("*").alias("total"), n(F.col("rule")).alias("deterministic"), n(~F.col("rule") & F.col("model")).alias("model_added"))


def false_block_codes(judged: DataFrame, *, label: str = "label", analysis: str = "analysis") -> DataFrame:
    return judged.where(F.col(label) == "allowed").select(F.explode(f"{analysis}.matched_policy_codes").alias("code")).groupBy("code").agg(F.count("*").alias("false_blocks"))


def false_block_sources(judged: DataFrame, *, label: str = "label", analysis: str = "analysis", sources: str = "sources") -> DataFrame:
    """How many allowed rows that were blocked come from each source. sources: an array, in which a source counts once a row."""
    wrong = judged.where((F.col(label) == "allowed") & (F.col(f"{analysis}.decision") == "BLOCKED"))
    return wrong.select(F.explode(F.array_distinct(sources)).alias("source")).groupBy("source").agg(F.count("*").alias("false_blocks"))


def expected_decision(value: Column) -> Column:
    """ALLOWED or BLOCKED for what a workbook says; null for anything else."""
    v = F.lower(F.trim(value))
    blocked = ["blocked", "block", "block / anonymize", "block/anonymize", "block/redact", "block/flag"]
    return F.when(v.isin("allow", "allowed", "safe"), "ALLOWED").when(v.isin(blocked), "BLOCKED")


def workbook_metrics(rows: DataFrame) -> DataFrame:
    """rows: sha256, expected (null if unlabelled), analysis. One row of the report's figures.

    All figures come from one sum over texts, so that what makes the analysis is run once.
    """
    decision, expected = F.col("analysis.decision"), F.col("expected")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    by_text = rows.groupBy("sha256").agg(
        F.count("*").alias("rows"),
        F.count("expected").alias("labeled"),
        n(decision == expected).alias("matched"),
        n((expected == "BLOCKED") & (decision == "ALLOWED")).alias("false_allowed"),
        n((expected == "ALLOWED") & (decision == "BLOCKED")).alias("false_blocked"),
        n(F.array_contains("analysis.safe_detection_summary", UNAVAILABLE)).alias("detector_errors"),
        F.min("expected").alias("least"),
        F.max("expected").alias("greatest"),
    )
    summed = ["rows", "labeled", "matched", "false_allowed", "false_blocked", "detector_errors"]
    sums = by_text.agg(*[n(F.col(c)).alias(c) for c in summed], F.count("sha256").alias("unique_prompts"), n(F.col("least") != F.col("greatest")).alias("conflicting_label_groups"))
    return sums.withColumn("accuracy", F.when(F.col("labeled") > 0, F.col("matched") / F.col("labeled")))
