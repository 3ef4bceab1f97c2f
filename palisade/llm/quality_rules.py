"""Quality rules by a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words, pairs of words and their hashes are computed in the row; each hash falls into one of `buckets` bins. Two
multinomials over the bins are fitted with additive smoothing: the trusted target (documents that labels mark as
good) and the raw corpus (all documents). A document's verdict is the mean, over its n-grams, of the log ratio of
the two: at `threshold` or above it is kept. Base rules come before the verdict.

Every count covers all rows. The fit explodes hashes, never words, and sums them per bin before its shuffle, so
that a task sends at most `buckets` rows. The fitted model has exactly `buckets` numbers whatever the corpus; it is
a constant of the scoring plan, which has neither join nor shuffle. The label table joins by broadcast only if it
has at most `broadcast_rows` good ids, else by shuffle of the labelled documents alone.

Defined results: a null or empty text has no words, fails the base rules and has the ratio 0. Repeated rows are
judged one by one. Without labels, or without any good label, the ratio is 0 everywhere, which is kept. An empty
table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, without

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def _hashes(text: Column) -> Column:
    """One 64-bit hash for each word of the text, in order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(hashes: Column, n: int) -> Column:
    """Hashes of n consecutive words."""
    count = F.size(hashes) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(*[F.get(hashes, i + (k - 1)) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _bins(hashes: Column, pairs: Column, buckets: int) -> Column:
    """Bins 0..buckets-1 of all words and pairs."""
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda refers to outside itself is computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(windows: Column, n: int) -> Column:
    """Words that lie in windows of n words found at least twice, given the windows' hashes in order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(sorted_: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i)["h"], F.lit(False))
        again = F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        # the words that each window adds to the windows before it
        added = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(p - F.get(at, k - 1), F.lit(n))))
        return F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)

    total = _let(placed, lambda s: _let(places(s), covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)


def base_measures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    hashed = docs.select(
        *keep,
        _hashes(F.col(text)).alias("__h"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("__lines"),
    )
    windowed = hashed.select(
        *keep,
        "__h",
        F.size("__h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _runs(F.col("__h"), 5).alias("__w"),
    )
    return windowed.select(*keep, "__h", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("__w"), 5).alias("n_repeat_words"))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", buckets: int = 16384, smoothing: float = 1.0, broadcast_rows: int = 2_000_000) -> list[float]:
    """The log ratio of each bin, target over raw. Exactly `buckets` numbers reach the driver."""
    good = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("__good")).where("__good is not null").distinct()
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t"))

    def counts(frame: DataFrame, name: str) -> DataFrame:
        hashed = frame.select(_hashes(F.col("__t")).alias("h"))
        binned = hashed.select(F.explode(_bins(F.col("h"), _runs(F.col("h"), 2), buckets)).alias("bin"))
        return binned.groupBy("bin").agg(F.count("*").alias(name))

    if good.count() <= broadcast_rows:
        flagged = rows.join(F.broadcast(good), F.col("__id") == F.col("__good"), "left")
        hashed = flagged.select(F.col("__good").isNotNull().cast("int").alias("g"), _hashes(F.col("__t")).alias("h"))
        binned = hashed.select("g", F.explode(_bins(F.col("h"), _runs(F.col("h"), 2), buckets)).alias("bin"))
        both = binned.groupBy("bin").agg(F.count("*").alias("raw"), F.sum("g").alias("target"))
    else:
        both = counts(rows, "raw").join(counts(rows.join(good, F.col("__id") == F.col("__good")), "target"), "bin", "left").na.fill(0)
    raw, target = [0] * buckets, [0] * buckets
    for row in both.collect():
        raw[row["bin"]], target[row["bin"]] = row["raw"], row["target"]
    import math

    n_raw, n_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    if not sum(target):
        return [0.0] * buckets
    return [math.log((t + smoothing) / n_target) - math.log((r + smoothing) / n_raw) for t, r in zip(target, raw)]


def apply_rules(docs: DataFrame, model: list[float], *, text: str = "text", threshold: float = -0.5, min_words: int = 10, max_repeat_percent: int = 20, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with the base measures, base_failed, llr (mean log ratio an n-gram) and kept."""
    keep = [f"`{c}`" for c in without(docs, [*FIELDS, "__h", "__w", "__lines"]) if carry is None or c in carry]
    measured = base_measures(docs, text, keep)
    ratios = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")
    bins = _bins(F.col("__h"), _runs(F.col("__h"), 2), len(model))
    total = F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    count = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    scored = measured.select(*keep, *FIELDS[:5], (total / count).alias("llr"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.select(*keep, *FIELDS[:5], failed.alias("base_failed"), "llr", (~failed & (F.col("llr") >= threshold)).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 16384, threshold: float = -0.5, carry: list[str] | None = None) -> DataFrame:
    """Fit on all of docs and labels, then judge every document."""
    return apply_rules(docs, fit(docs, labels, doc_id=doc_id, text=text, buckets=buckets), text=text, threshold=threshold, carry=carry)
