"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are words and their first 4, 5 and 6 bytes, so that inflected forms share evidence. Their log-odds between
toxic and other labelled documents have an informative Dirichlet prior: pseudo-counts in proportion to the counts of
all documents. A token has the log-odds of its strongest feature that is significantly toxic, any other token costs
`drift`; so scores fall on average and a passage has to earn its length. A linear-time scan finds all maximal
scoring segments of a text. Segment scores are calibrated as extreme values: with lambda and K of the clean labelled
documents, a segment of score S in a text of n words is expected E = K n exp(-lambda S) times by chance. Segments of
small E are the passages; the evidence of the best one and of all together gives the score by a logistic fit.

Labels are learned from a bounded sample: at most `max_toxic` toxic and `max_clean` other labelled rows, those of
least hash (all of them where there are fewer). The prior covers all documents. The candidate features are those
of at least `min_docs` sampled toxic documents, so their number is bounded by the sample; only they reach the
driver. Scoring is row-wise with no shuffle.

Defined results: a null or empty text has no passages and the score of a text without evidence. Without usable
labels every score is the toxic share of the sample (0 if it is empty). A row without id is in no sample. Repeated
rows are scored one by one. An empty table gives an empty result. Input columns named like a result column are
replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words_of, map_columns, short_batches

PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("segment_score", T.DoubleType())]))


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of))


def features(word: bytes) -> set[bytes]:
    return {word + b"$", word[:4], word[:5], word[:6]}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Only positive scores open segments. Each segment on the stack holds the total before and after it; a new one is
    joined to the last one that began lower, as long as that one's top isn't higher than its own.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each segment, the last one before it that began lower (-1: none)
    for i in np.flatnonzero(scores > 0):
        start, low, high = int(i), float(totals[i]), float(totals[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = lower[j]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, int(i) + 1, low, high))
                lower.append(j)
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:], lower[j:]
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass
class ToxicModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    drift: float = 1.0
    lam: float = 1.0
    k: float = 1.0
    bias: float = -30.0
    slopes: tuple[float, float] = (0.0, 0.0)
    max_e: float = 0.05

    def scorer(self):
        known: dict[bytes, float] = {}
        weights, drift = self.weights, self.drift

        def scores(words: list[bytes]) -> np.ndarray:
            if len(known) > 500_000:
                known.clear()
            out = []
            for w in words:
                s = known.get(w)
                if s is None:
                    s = known[w] = max((weights[f] for f in features(w) if f in weights), default=-drift)
                out.append(s)
            return np.array(out)

        return scores

    def evidence(self, words: int, found: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float]]]:
        """-log10 E of the best segment, log2 of 1 + the sum of the positive ones, and the significant segments."""
        each = [(self.lam * s - math.log(self.k * max(words, 1))) / math.log(10) for _, _, s in found]
        good = [x for x in each if x > 0]
        passages = [seg for seg, x in zip(found, each) if x >= -math.log10(self.max_e)]
        return min(max(each, default=-3.0), 30.0), math.log2(1 + sum(good)), passages

    def probability(self, best: float, total: float) -> float:
        x = self.bias + self.slopes[0] * best + self.slopes[1] * total
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _sample(labels: DataFrame, doc_id: str, label: str, max_toxic: int, max_clean: int) -> DataFrame:
    """(__id, __toxic) of the labelled rows of least hash, at most max_toxic and max_clean."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__toxic"))
    pick = lambda kind, n: usable.where(F.col("__toxic") == kind).orderBy(F.xxhash64("__id"), "__id").limit(n)
    return pick(1, max_toxic).unionByName(pick(0, max_clean))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = 50_000, max_clean: int = 200_000, min_docs: int = 5, prior: float = 5_000.0, min_z: float = 4.0, drift: float = 1.0, clip: float = 8.0) -> ToxicModel:
    """Learn from docs with labels. The caller leaves held-out labels out."""
    spark = docs.sparkSession
    sample = F.broadcast(_sample(labels, doc_id, label, max_toxic, max_clean))
    marked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(sample, "__id", "left").select("__text", F.coalesce("__toxic", F.lit(-1)).cast("int").alias("__toxic"))

    def toxic_features(batches):
        seen = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update({f for w in set(alnum_words_of(value)) for f in features(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

    each = marked.where("__toxic = 1").select("__text").mapInArrow(toxic_features, "f binary, n long")
    candidates = {bytes(r[0]) for r in each.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("f").collect()}
    shared = spark.sparkContext.broadcast(candidates)
    short_batches(spark)

    def counts(batches):
        wanted, known = shared.value, {}
        sums: list[Counter] = [Counter(), Counter(), Counter()]  # all documents, toxic, clean
        totals = [0, 0, 0]

        def add(words: Counter, to: list[int]):
            for w, n in words.items():
                hit = known.get(w)
                if hit is None:
                    if len(known) > 500_000:
                        known.clear()
                    hit = known[w] = tuple(f for f in features(w) if f in wanted)
                for f in hit:
                    for k in to:
                        sums[k][f] += n

        for batch in batches:
            words: dict[int, Counter] = {-1: Counter(), 0: Counter(), 1: Counter()}
            for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[kind].update(alnum_words_of(value))
            for kind, some in words.items():
                to = [0] if kind < 0 else [0, 1 if kind else 2]
                add(some, to)
                for k in to:
                    totals[k] += some.total()
        names = [b"", *sums[0]]
        columns = [pa.array([totals[k], *(sums[k][f] for f in names[1:])], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *columns], names=["f", "a", "t", "c"])

    # the empty name carries the totals
    got = {bytes(r[0]): r[1:] for r in marked.mapInArrow(counts, "f binary, a long, t long, c long").groupBy("f").agg(F.sum("a"), F.sum("t"), F.sum("c")).collect()}
    n_all, n_toxic, n_clean = got.pop(b"", (0, 0, 0))
    shared.destroy()
    model = ToxicModel(drift=drift)
    for f, (a, t, c) in got.items():
        alpha = prior * a / max(n_all, 1)
        if not t or not n_clean:
            continue
        odds = math.log((t + alpha) / (n_toxic + prior - t - alpha)) - math.log((c + alpha) / (n_clean + prior - c - alpha))
        if odds / math.sqrt(1 / (t + alpha) + 1 / (c + alpha)) >= min_z and odds > drift:
            model.weights[f] = min(odds, clip)
    return _calibrated(marked, model)


def _calibrated(marked: DataFrame, model: ToxicModel) -> ToxicModel:
    """lambda and K from the clean sampled documents, then the logistic fit on all sampled ones."""
    context = marked.sparkSession.sparkContext
    shared = context.broadcast(model)

    def chance(batches):
        """Token scores of clean texts in bins of a quarter, and sums of their best segments and log lengths (in bin null)."""
        scores, bins, sums = shared.value.scorer(), Counter(), [0, 0.0, 0.0]
        for batch in batches:
            for value in batch.column(0).to_pylist():
                s = scores(alnum_words_of(value))
                if len(s):
                    values, n = np.unique(np.round(s * 4).astype(int), return_counts=True)
                    bins.update(dict(zip(values.tolist(), n.tolist())))
                    sums = [sums[0] + 1, sums[1] + max((x[2] for x in segments(s)), default=0.0), sums[2] + math.log(len(s))]
        rows = [(int(v), int(n), 0.0, 0.0) for v, n in bins.items()] + [(None, *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["v", "n", "s", "l"])

    found = marked.where("__toxic = 0").select("__text").mapInArrow(chance, "v long, n long, s double, l double").groupBy("v").agg(F.sum("n"), F.sum("s"), F.sum("l")).collect()
    bins = {v / 4: n for v, n, _, _ in found if v is not None}
    n_clean, sum_best, sum_logs = next(((n, s, logs) for v, n, s, logs in found if v is None), (0, 0.0, 0.0))
    total = sum(bins.values()) + 1
    # one unseen token of the highest weight, so that the equation always has a root
    top = max(model.weights.values(), default=1.0)
    share = [(v, n / total) for v, n in bins.items()] + [(top, 1 / total)]
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(p * math.exp(min(700.0, mid * v)) for v, p in share) < 1 else (low, mid)
    model.lam = low
    if n_clean:
        # the mean of an extreme value is (ln(K n) + Euler's constant) / lambda
        model.k = min(1.0, max(1e-6, math.exp((model.lam * sum_best - sum_logs) / n_clean - 0.5772156649)))
    shared.destroy()
    told = context.broadcast(model)

    def evidence(batches):
        scores = told.value.scorer()
        for batch in batches:
            each = []
            for value in batch.column(0).to_pylist():
                s = scores(alnum_words_of(value))
                each.append(told.value.evidence(len(s), segments(s))[:2])
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([e[i] for e in each], pa.float64()) for i in (0, 1))], names=["kind", "best", "total"])

    # three numbers for each row of the bounded sample
    docs = marked.where("__toxic >= 0").select("__text", "__toxic").mapInArrow(evidence, "kind int, best double, total double").toArrow()
    told.destroy()
    y, best, sums = (docs.column(i).to_numpy().astype(float) for i in range(3))
    order = np.lexsort((sums, best, y))
    y, best, sums = y[order], best[order], sums[order]
    if not len(y):
        return model
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    model.bias = math.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        x = np.column_stack([np.ones(len(y)), best, sums])
        w, ridge = np.array([model.bias, 0.0, 0.0]), np.diag([1e-3, 1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-8:
                break
        model.bias, model.slopes = float(w[0]), (float(w[1]), float(w[2]))
    return model


def score(docs: DataFrame, model: ToxicModel, *, text: str = "text", threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with score, predicted and passages (word ranges of the significant segments)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", PASSAGE)]

    def make():
        m = shared.value
        scores = m.scorer()

        def run(cols):
            out: list[list] = [[], [], []]
            for value in cols[0].to_pylist():
                words = alnum_words_of(value)
                best, total, passages = m.evidence(len(words), segments(scores(words)))
                p = m.probability(best, total)
                out[0].append(p)
                out[1].append(int(p >= threshold))
                out[2].append([{"start": a, "end": b, "segment_score": s} for a, b, s in passages])
            return out

        return run

    return map_columns(docs, [text], docs.columns if carry is None else carry, fields, make)


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", held_out: tuple[int, int] = (4, 2), threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """Learn from the labels outside the held-out fold, and score every document; held_out says which fold it is in."""
    of, out = held_out
    model = fit(docs, labels.where(fold(F.col(doc_id), of) != out), doc_id=doc_id, text=text, label=label)
    carry = docs.columns if carry is None else carry
    marked = docs.withColumn("held_out", fold(F.col(doc_id), of) == out)
    return score(marked, model, text=text, threshold=threshold, carry=[*[c for c in carry if c.lower() != "held_out"], "held_out"])
