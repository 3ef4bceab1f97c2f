"""Quality classifier by co-training of a text view and a metadata view.

The text view has hashed words, hashed word endings and the share of words that repeat the one before. The metadata
view has language, source and the page's shape: lengths, lines, shares of capitals, symbols and white space. Each
view is a logistic regression. In each round both views label all unlabelled documents, in tasks; the `added` ones that
a view is surest of, at least `sure`, in the proportion of the classes, join the other view's training set. At the end
each view is calibrated on labelled rows kept aside, and a logistic combination of both calibrated views scores every
document.

The labelled sample is bounded: at most `max_labelled` rows, those of least hash (all where there are fewer). The
unlabelled pool is whole; of it, only the documents that a round adds reach the driver, as hashed features. All
documents are scored row by row; only ids, hashes and scores are shuffled.

Defined results: a null or empty text has no words; its metadata still speak. A null source or language is a value
of its own. With no labels, or labels of one class only, every score is 0.5 and everything is kept. A row without id is
in no sample. Repeated rows are scored one by one; as pseudo-labels, equal texts count once. An empty table gives an
empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_columns, staged
from .shingles import _mix, word_hashes

_U = np.uint64
TEXT_SIZE, META_SIZE = 1 << 15, 1 << 10
#: Of each byte of UTF-8: 1 for a capital, 2 for a symbol, 3 for white space.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[65:91] = 1
_KINDS[list(b"#*$%&|<>@~^=+_\\{}[]!")] = 2
_KINDS[[9, 10, 11, 12, 13, 32]] = 3


def text_features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each text; the values of words have length 1."""
    h, offsets, tails = word_hashes(texts, tails=True)
    half = TEXT_SIZE // 2
    words = (h % _U(half)).astype(np.int64)
    ends = half + 1 + (_mix(tails.astype(_U) + _U(77)) % _U(half - 1)).astype(np.int64)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        keys, values = [], []
        for part in (words[a:b], ends[a:b]):
            k, n = np.unique(part, return_counts=True)
            keys.append(k)
            values.append(n / max(1e-9, float(np.sqrt((n * n).sum()))))
        same = float((h[a + 1 : b] == h[a : b - 1]).mean()) if b - a > 1 else 0.0
        out.append((np.concatenate([*keys, [half]]), np.concatenate([*values, [2 * same]])))
    return out


def meta_features(text: str | None, lang: str | None, source: str | None) -> list[int]:
    """Feature numbers of the metadata view: each is a name with a value in bins."""
    t = text or ""
    n, lines = len(t), t.count("\n") + 1
    kinds = np.bincount(_KINDS[np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=4)
    share = lambda count: int(20 * count / n) if n else -1
    named = [
        ("lang", lang),
        ("source", source),
        ("length", n.bit_length()),
        ("lines", lines.bit_length()),
        ("line", (n // lines).bit_length()),
        ("upper", share(int(kinds[1]))),
        ("symbols", share(int(kinds[2]))),
        ("space", share(int(kinds[3]))),
        ("chars", len(set(t)).bit_length()),
    ]
    return sorted({zlib.crc32(f"{k}={v}".encode("utf-8", "surrogatepass")) % META_SIZE for k, v in named})


class Sparse:
    """Rows of (feature numbers, values). Products go by stretches of entries, so that their temporaries stay small."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int, stretch: int = 1 << 19):
        self.size, self.rows = size, len(rows)
        self.ends = np.cumsum([0, *(len(k) for k, _ in rows)])
        self.key = np.concatenate([k for k, _ in rows]).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float32, copy=False) if rows else np.zeros(0, np.float32)
        cuts = np.searchsorted(self.ends, np.arange(0, self.ends[-1] + stretch, stretch))
        self.parts = [(a, b) for a, b in zip(cuts[:-1], np.minimum(cuts[1:], self.rows)) if b > a]

    def _rows(self, a: int, b: int) -> np.ndarray:
        return np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.full(self.rows, w[-1])
        for a, b in self.parts:
            i, j = self.ends[a], self.ends[b]
            out[a:b] += np.bincount(self._rows(a, b), weights=self.value[i:j] * w[self.key[i:j]], minlength=b - a)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        for a, b in self.parts:
            i, j = self.ends[a], self.ends[b]
            out += np.bincount(self.key[i:j], weights=self.value[i:j] * r[a:b][self._rows(a, b)], minlength=self.size)
        return np.append(out, r.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 1.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the constant) by full-batch gradient steps with a scale for each weight."""
    w, seen = np.zeros(x.size + 1), np.full(x.size + 1, 1e-8)
    for _ in range(steps):
        g = x.back(weight * (_sigmoid(x.times(w)) - y)) / max(weight.sum(), 1e-9) + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _platt(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant and slopes of a logistic fit on few columns, with smoothed targets."""
    x = np.column_stack([np.ones(len(logits)), logits])
    good, bad = y.sum(), len(y) - y.sum()
    t, w = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2)), np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (t - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return w


@dataclass
class CoModel:
    text: np.ndarray = field(default_factory=lambda: np.zeros(TEXT_SIZE + 1))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META_SIZE + 1))
    text_scale: tuple[float, float] = (0.0, 0.0)
    meta_scale: tuple[float, float] = (0.0, 0.0)
    both: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def views(self, text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] + self.text_scale[1] * text.times(self.text)
        b = self.meta_scale[0] + self.meta_scale[1] * meta.times(self.meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both[0] + self.both[1] * a + self.both[2] * b)


def _featured(docs: DataFrame, text: str, lang: str, source: str, carry: list[str]) -> DataFrame:
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.FloatType())
    fields = [T.StructField("__k", ints), T.StructField("__v", doubles), T.StructField("__m", ints)]

    def make():
        def run(cols):
            texts, langs, sources = (c.to_pylist() for c in cols)
            found = text_features(texts)
            return [[k.astype(np.int32) for k, _ in found], [v.astype(np.float32) for _, v in found], [meta_features(*x) for x in zip(texts, langs, sources)]]

        return run

    return map_columns(docs, [text, lang, source], carry, fields, make)


def _lists(column) -> list[np.ndarray]:
    """The arrays of a list column, as views of one buffer."""
    whole = column.combine_chunks() if hasattr(column, "chunks") else column
    values, ends = whole.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(whole.offsets.to_numpy()))])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _gathered(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str, lang: str, source: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Of the documents in chosen(__sid, __y, __x), a bounded number: hashes of ids and of contents, labels, both views' rows.

    One row for each id and content hash; where __x is null, one for the id.
    """
    x = F.xxhash64(text, lang, source)
    met = (F.col(doc_id) == F.col("__sid")) & (F.col("__x").isNull() | (x == F.col("__x")))
    some = docs.join(F.broadcast(chosen), met).select("__sid", "__x", F.struct(x.alias("x"), "__y", F.col(text).alias("__t"), F.col(lang).alias("__l"), F.col(source).alias("__s")).alias("r"))
    some = some.groupBy("__sid", "__x").agg(F.min("r").alias("r")).select("__sid", "r.*")
    table = _featured(some, "__t", "__l", "__s", ["__sid", "__y", "x"]).select(F.xxhash64("__sid").alias("h"), "x", "__y", "__k", "__v", "__m").toArrow().combine_chunks()
    table = table.take(np.lexsort((table.column("x").to_numpy(), table.column("h").to_numpy())))
    metas = _lists(table.column("__m"))
    h, x, y = (table.column(c).to_numpy() for c in ("h", "x", "__y"))
    return h, x, y, list(zip(_lists(table.column("__k")), _lists(table.column("__v")))), [(m, np.ones(len(m), dtype=np.float32)) for m in metas]


def _labelled_by_views(docs: DataFrame, known: DataFrame, weights: list[np.ndarray], doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """(x, __sid, p0, p1): both views' probabilities for each different unlabelled text, with the least id that it stands under."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    fields = [T.StructField("p0", T.DoubleType()), T.StructField("p1", T.DoubleType())]

    def make():
        by_text, by_meta = shared.value

        def run(cols):
            texts, langs, sources = (c.to_pylist() for c in cols)
            meta = [np.array(meta_features(*x), dtype=np.int64) for x in zip(texts, langs, sources)]
            return [_sigmoid(Sparse(text_features(texts), TEXT_SIZE).times(by_text)), _sigmoid(Sparse([(k, np.ones(len(k))) for k in meta], META_SIZE).times(by_meta))]

        return run

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__sid"), F.xxhash64(text, lang, source).alias("x"), F.col(text).alias("__t"), F.col(lang).alias("__l"), F.col(source).alias("__s"))
    judged = map_columns(rows, ["__t", "__l", "__s"], ["__sid", "x"], fields, make).join(known.select(F.col("__id").alias("__sid")), "__sid", "left_anti")
    found = staged(judged.groupBy("x").agg(F.min("__sid").alias("__sid"), F.min("p0").alias("p0"), F.min("p1").alias("p1")), "pseudo-labels")
    shared.destroy()
    return found


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality", max_labelled: int = 10_000, added: int = 500, rounds: int = 2, sure: float = 0.95) -> CoModel:
    """Co-train. A fifth of the labelled rows is kept aside for calibration."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    known = staged(known, "known-labels")
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled).select(F.col("__id").alias("__sid"), "__y", F.lit(None).cast("long").alias("__x"))
    columns = (doc_id, text, lang, source)
    hashes, _, y, *views = _gathered(docs, chosen, *columns)
    sizes = [TEXT_SIZE, META_SIZE]
    model = CoModel()
    if not (y == 0).any() or not (y == 1).any():
        return model
    aside = (hashes >> 7) % 5 == 2
    if not (y[aside] == 0).any() or not (y[aside] == 1).any():
        aside = np.ones(len(y), dtype=bool)
    train = np.flatnonzero(~aside) if not aside.all() else np.arange(len(y))
    good = float(y[train].mean())
    given = [([data[i] for i in train], [float(y[i]) for i in train]) for data in views]
    taken: list[set] = [set(), set()]
    weights: list[np.ndarray] = []
    for turn in range(rounds + 1):
        weights = []
        for (rows, targets), size in zip(given, sizes):
            target = np.array(targets)
            balance = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
            weights.append(logistic(Sparse(rows, size), target, balance))
        if turn == rounds:
            break
        judged = _labelled_by_views(docs, known, weights, *columns)
        picks: list[tuple[int, float, object]] = []  # (view that learns, label, row)
        for v in (0, 1):
            for kind, p, n in ((1.0, F.col(f"p{v}"), round(added * good)), (0.0, 1 - F.col(f"p{v}"), round(added * (1 - good)))):
                # what the other view has been given already may stand first
                first = judged.where(p >= sure).orderBy(p.desc(), F.xxhash64("x"), "x").limit(max(1, n) + len(taken[1 - v])).collect()
                new = [r for r in first if r["x"] not in taken[1 - v]][: max(1, n)]
                taken[1 - v].update(r["x"] for r in new)
                picks += [(1 - v, kind, r) for r in new]
        if picks:
            wanted = T.StructType([T.StructField("__sid", judged.schema["__sid"].dataType), T.StructField("__y", T.IntegerType()), T.StructField("__x", T.LongType())])
            rows = docs.sparkSession.createDataFrame([(sid, -1, x) for sid, x in sorted({(r["__sid"], r["x"]) for *_, r in picks})], wanted)
            _, contents, _, *more = _gathered(docs, rows, *columns)
            at = {int(x): i for i, x in enumerate(contents)}
            for v, kind, r in picks:
                given[v][0].append(more[v][at[r["x"]]])
                given[v][1].append(kind)
        discard(judged)
    model.text, model.meta = weights
    at = np.flatnonzero(aside)
    a, b = (Sparse([data[i] for i in at], size).times(w) for data, size, w in zip(views, sizes, weights))
    model.text_scale, model.meta_scale = tuple(_platt(a[:, None], y[at])), tuple(_platt(b[:, None], y[at]))
    calibrated = np.column_stack([s[0] + s[1] * x for s, x in ((model.text_scale, a), (model.meta_scale, b))])
    model.both = tuple(_platt(calibrated, y[at]))
    return model


def score(docs: DataFrame, model: CoModel, *, text: str = "text", lang: str = "lang", source: str = "source", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with text_score, meta_score, quality_score and kept (quality_score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    double = T.DoubleType()
    fields = [T.StructField("text_score", double), T.StructField("meta_score", double), T.StructField("quality_score", double), T.StructField("kept", T.BooleanType())]

    def make():
        m = shared.value

        def run(cols):
            texts, langs, sources = (c.to_pylist() for c in cols)
            meta = [np.array(meta_features(*x), dtype=np.int64) for x in zip(texts, langs, sources)]
            a, b, both = m.views(Sparse(text_features(texts), TEXT_SIZE), Sparse([(k, np.ones(len(k))) for k in meta], META_SIZE))
            return [a, b, both, both >= threshold]

        return run

    return map_columns(docs, [text, lang, source], docs.columns if carry is None else carry, fields, make)


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    return score(docs, fit(docs, labels, doc_id=doc_id, text=text, lang=lang, source=source, label=label), text=text, lang=lang, source=source, threshold=threshold, carry=carry)
