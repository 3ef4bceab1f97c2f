"""Language-model scores of texts by a hashed maximum-entropy model.

A token is reached on a path of classes: 256 classes by spelling (the hash of its last two bytes), taken in two steps of
16, each with 16 slots by hash. P(token | history) is the product of a softmax over 16 for each step, given the
history and the steps before, and of the token's smoothed share in its slot. So the softmax is factored by class, unseen
tokens have a path too, and all outcomes of a position have a total of 1. The end of a text is a token of class 0.

The logits of a step sum one weight row of 16 for each active feature: a constant, the token before, the two tokens
before (n-grams), and the classes of the tokens one, two and three places before (skips). Features are hashed together
with the path into `ROWS` rows.

Training reads every training token once, in `rounds` parts of the documents. In a part, each task starts from the
common weights and makes gradient updates over its tokens in batches, with a step for each row by its past gradients.
The changes are averaged for each row, by how often each task met it; they are added up on executors in
pieces, so the driver gets the fixed-size table once a round. Scoring gathers and adds the sparse rows of a batch in numpy.

In a slot, the maximum-entropy solution for constant features is the smoothed share (count + 1) / (slot count + slot types
+ 1), where the one extra type stands for what training didn't see. Counts of all training tokens are exact, by the upper
56 bits of a hash and the class, and grow with the corpus. A vocabulary of up to `broadcast_types` types goes to the tasks
as two sorted arrays; a larger one is joined by shuffle with each text's distinct tokens.

Defined results: a null or empty text has one token, the end. A null id counts as the empty text for the fold. Without
training documents every token is unseen. Repeated rows are scored one by one. An empty table gives an empty result.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, short_batches, staged
from .shingles import _mix, word_hashes
from .toxicity import fold

CLASSES, SLOTS = 256, 16
LEAVES = CLASSES * SLOTS
WIDTH = 16
#: How many kinds of features each step has. The rarest kind, of two tokens, bears on the first step of the class only.
KINDS = (6, 5, 4)
BITS = 17
ROWS = 1 << BITS
_U = np.uint64
_END = np.int64(0x5DEECE66D1234567)
_ODD = _U(0xD6E8FEB86659FD93)
_FIELDS = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
#: A hash of each place on a path: the root, 16 half classes, 256 classes.
_PATHS = _mix(np.arange(1, 2 + WIDTH + CLASSES, dtype=_U) * _ODD)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, class and hashed features of all tokens of all texts (each text's words and then its end), and offsets by text.

    A key is a token's hash with its class in the low byte; features have a row for each kind.
    """
    words, offsets, tails = word_hashes(texts, tails=True)
    at = offsets + np.arange(len(offsets))
    h, cls = np.full(int(at[-1]), _END, dtype=np.int64), np.zeros(int(at[-1]), dtype=np.int64)
    inside = np.ones(len(h), dtype=bool)
    inside[at[1:] - 1] = False
    h[inside] = words.view(np.int64)
    cls[inside] = 1 + (_mix(tails.astype(_U)) % _U(CLASSES - 1)).astype(np.int64)
    keys = (h & ~np.int64(255)) | cls
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))

    def before(values: np.ndarray, n: int, first) -> np.ndarray:
        """What stands n places before; an end stands before the first token."""
        out = np.full_like(values, first)
        out[n:] = values[: len(values) - n]
        out[place < n] = first
        return out

    end = (_END & ~np.int64(255)).view(np.int64)
    one, two = before(keys, 1, end).view(_U), before(keys, 2, end).view(_U)
    kinds = [np.zeros(len(h), dtype=_U), one, *(before(cls, n, 0).astype(_U) for n in (1, 2, 3)), one * _ODD + two]
    return keys, cls, np.stack([_mix(k + _U(i << 60)) for i, k in enumerate(kinds)]), at


def path(keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each step, the places on the paths of keys before it and the outcomes taken."""
    cls, slot = keys & np.int64(CLASSES - 1), (keys >> 8) & np.int64(SLOTS - 1)
    return [np.zeros_like(cls), 1 + (cls >> 4), 1 + WIDTH + cls], [cls >> 4, cls & 15, slot]


def leaf(keys: np.ndarray) -> np.ndarray:
    return (keys & np.int64(CLASSES - 1)) * SLOTS + ((keys >> 8) & np.int64(SLOTS - 1))


def feature_rows(features: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The active weight rows at these places, one row for each kind of feature."""
    return (((features ^ _PATHS[places]) * _ODD) >> _U(64 - BITS)).view(np.int64)


def log_shares(x: np.ndarray) -> np.ndarray:
    """The logarithms of the softmax of each row."""
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[0], axis=0, mode="clip")
    for kind in rows[1:]:
        out += np.take(weights, kind, axis=0, mode="clip")
    return out


def path_logs(weights: np.ndarray, keys: np.ndarray, features: np.ndarray, stretch: int = 8192) -> np.ndarray:
    """The natural logarithm of the probability of each key's slot."""
    out = np.zeros(len(keys))
    for a in range(0, len(keys), stretch):
        part = slice(a, a + stretch)
        for kinds, places, taken in zip(KINDS, *path(keys[part])):
            x = log_shares(logits(weights, feature_rows(features[:kinds, part], places)))
            out[part] += x[np.arange(len(taken)), taken]
    return out


class Learner:
    """Gradient updates from common weights, with a step for each row by its past gradients."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate = weights.copy(), np.float32(rate)
        self.past, self.met = np.full(len(weights), 1e-3, dtype=np.float32), np.zeros(len(weights), dtype=np.float32)

    def update(self, keys: np.ndarray, features: np.ndarray) -> None:
        for kinds, places, taken in zip(KINDS, *path(keys)):
            rows = feature_rows(features[:kinds], places)
            gap = np.exp(log_shares(logits(self.weights, rows)))
            gap[np.arange(len(taken)), taken] -= 1
            # sorted by row, with the token's number in the low bits
            order = np.sort(((rows << 20) | np.arange(len(taken))).ravel())
            at = order >> 20
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            some, n = at[first], np.diff(first, append=len(at)).astype(np.float32)
            # a row's mean gradient over the batch, times the square root of how often it stands there
            slope = np.add.reduceat(np.take(gap, order & 0xFFFFF, axis=0, mode="clip"), first)
            slope /= np.sqrt(n)[:, None]
            past = self.past[some] + np.einsum("ij,ij->i", slope, slope)
            self.past[some] = past
            slope *= (self.rate / np.sqrt(past))[:, None]
            self.weights[some] -= slope
            self.met[some] += n


@dataclass
class Model:
    weights: np.ndarray  # ROWS x WIDTH
    leaf_tokens: np.ndarray
    leaf_types: np.ndarray
    counts: DataFrame  # h, n

    @property
    def total(self) -> int:
        return int(self.leaf_tokens.sum())

    @property
    def types(self) -> int:
        return int(self.leaf_types.sum())


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def _counts(train: DataFrame, text: str) -> DataFrame:
    """(h, n): how often each token's key stands in the training texts; added up in tasks and then by key."""
    short_batches(train.sparkSession)

    def run(batches):
        held: list[list[np.ndarray]] = [[], []]

        def out(keys, n):
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["h", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                values, n = np.unique(tokens(whole.slice(at, 512).column(0).to_pylist())[0], return_counts=True)
                held[0].append(values)
                held[1].append(n)
                if sum(map(len, held[0])) > 2_000_000:
                    keys, n = _summed(*held)
                    if len(keys) > 1_500_000:
                        yield from out(keys, n)
                        held = [[], []]
                    else:
                        held = [[keys], [n]]
        if held[0]:
            yield from out(*_summed(*held))

    return train.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _round(train: DataFrame, text: str, weights: np.ndarray, rate: float, batch_tokens: int, pieces: int = 64) -> np.ndarray:
    """The weights after gradient updates over train, averaged over the tasks."""
    shared = train.sparkSession.sparkContext.broadcast(weights)
    size = ROWS // pieces

    def learn(batches):
        start, learner = shared.value, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                learner = learner or Learner(start, rate)
                keys, _, features, _ = tokens(whole.slice(at, 256).column(0).to_pylist())
                for a in range(0, len(keys), batch_tokens):
                    learner.update(keys[a : a + batch_tokens], features[:, a : a + batch_tokens])
        if learner:
            change = (learner.weights - start).astype(np.float16)  # half the bytes to shuffle
            for piece in range(pieces):
                rows = slice(piece * size, (piece + 1) * size)
                blob = learner.met[rows].tobytes() + change[rows].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([blob], pa.binary())], names=["piece", "blob"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                met = np.frombuffer(blob.as_buffer(), dtype=np.float32, count=size).astype(np.float64)[:, None]
                part = np.hstack([met, met * np.frombuffer(blob.as_buffer(), dtype=np.float16, offset=4 * size).reshape(size, WIDTH)])
                sums[piece] = sums[piece] + part if piece in sums else part
        for piece, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["piece", "blob"])

    schema = "piece int, blob binary"
    told = train.select(text).mapInArrow(learn, schema).repartition(pieces // 4, "piece").mapInArrow(add, schema)
    out = weights.copy()
    for piece, blob in told.collect():  # `pieces` rows, a table of fixed size in all
        part = np.frombuffer(blob, dtype=np.float32).reshape(size, 1 + WIDTH)
        out[piece * size : (piece + 1) * size] += part[:, 1:] / np.maximum(part[:, :1], 1)
    shared.destroy()
    return out


def fit(train: DataFrame, *, text: str = "text", rounds: int = 2, rate: float = 0.6, batch_tokens: int = 16384) -> Model:
    """Train on every row."""
    counts = staged(_counts(train, text), "lm-counts")
    by_leaf = counts.groupBy((F.col("h").bitwiseAND(F.lit(CLASSES - 1)) * SLOTS + F.shiftright("h", 8).bitwiseAND(F.lit(SLOTS - 1))).alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).toArrow()
    leaf_tokens, leaf_types = np.zeros(LEAVES), np.zeros(LEAVES)
    at = by_leaf.column("leaf").to_numpy()
    leaf_tokens[at], leaf_types[at] = by_leaf.column("n").to_numpy(), by_leaf.column("t").to_numpy()
    weights = np.zeros((ROWS, WIDTH), dtype=np.float32)
    # a task of several small partitions sends its table once; the rows stay where they are
    parts, cores = train.rdd.getNumPartitions(), train.sparkSession.sparkContext.defaultParallelism
    few = train.coalesce(max(min(parts, 2 * cores), parts // 8))
    for number in range(rounds):
        part = few.where(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(rounds)) == number)
        weights = _round(part, text, weights, rate, batch_tokens)
    return Model(weights, leaf_tokens, leaf_types, counts)


def _counted_here(docs: DataFrame, model: Model, text: str) -> tuple:
    """A function from token keys to their counts, from two sorted arrays that each task gets."""
    small = model.total < 1 << 31
    table = model.counts.select("h", F.col("n").cast("int" if small else "long").alias("n")).toArrow()
    keys, n, at = np.empty(len(table), np.int64), np.empty(len(table), np.int32 if small else np.int64), 0
    for batch in table.to_batches():  # copied piece by piece, so that few copies are alive at once
        keys[at : at + len(batch)], n[at : at + len(batch)] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at += len(batch)
    del table
    pa.default_memory_pool().release_unused()
    order = np.argsort(keys).astype(np.int32 if at < 1 << 31 else np.int64)
    keys, n = keys[order], n[order]
    del order
    return docs.sparkSession.sparkContext.broadcast((keys, n))


def _counted_by_shuffle(docs: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    """(__id, __x, __known, __logs) of each different (id, text): tokens that training saw, and the sum of log10(count + 1)."""
    fields = [T.StructField("__keys", T.ArrayType(T.LongType())), T.StructField("__times", T.ArrayType(T.LongType()))]

    def make():
        def run(cols):
            keys, _, _, at = tokens(cols[0].to_pylist())
            each = [np.unique(keys[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
            return [[k for k, _ in each], [n for _, n in each]]

        return run

    some = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__x"), F.col(text).alias("__text"))
    keyed = map_columns(some, ["__text"], ["__id", "__x"], fields, make)
    pairs = keyed.select("__id", "__x", F.explode(F.arrays_zip("__keys", "__times")).alias("p")).select("__id", "__x", F.col("p.__keys").alias("h"), F.col("p.__times").alias("times"))
    joined = pairs.join(model.counts, "h", "left")
    sums = joined.groupBy("__id", "__x").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("__known"), F.sum(F.coalesce(F.log10(F.col("n") + 1), F.lit(0.0)) * F.col("times")).alias("__logs"))
    # repeated rows have added up
    times = some.groupBy("__id", "__x").agg(F.count("*").alias("__rows")).withColumnsRenamed({"__id": "__i", "__x": "__y"})
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__x").eqNullSafe(F.col("__y"))
    return sums.join(times, same).select("__id", "__x", F.expr("__known div __rows").alias("__known"), (F.col("__logs") / F.col("__rows")).alias("__logs"))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, broadcast_types: int = 6_000_000) -> DataFrame:
    """The rows of docs with n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {n for n, _ in _FIELDS}]
    total, types = model.total, model.types
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, np.log10(model.leaf_tokens + model.leaf_types + 1)))
    base = float(np.log10(total + types + 1))
    here = _counted_here(docs, model, text) if types <= broadcast_types else None
    fields = [T.StructField("__n", T.LongType()), T.StructField("__c", T.DoubleType()), T.StructField("__k", T.LongType()), T.StructField("__l", T.DoubleType())]

    def make():
        weights, inside = shared.value
        keys, n = here.value if here is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def run(cols):
            wanted, _, features, at = tokens(cols[0].to_pylist())
            logs = path_logs(weights, wanted, features) / np.log(10.0) - inside[leaf(wanted)]
            known, tops = np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
            if len(keys):
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                known = keys[place] == wanted
                tops = np.where(known, np.log10(n[place] + 1.0), 0.0)
            add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
            return [np.diff(at), add(logs), add(known.astype(np.int64)), add(tops)]

        return run

    if here is not None:
        rows = map_columns(docs, [text], carry, fields, make, rows=256)
    else:
        need = docs.withColumn("__id", F.col(doc_id)).withColumn("__x", F.xxhash64(text))
        rows = map_columns(need, [text], [*carry, "__id", "__x"], fields[:2] + [T.StructField("__zero", T.LongType()), T.StructField("__none", T.DoubleType())], make, rows=256)
        counted = _counted_by_shuffle(docs, model, doc_id, text).withColumnsRenamed({"__id": "__i", "__x": "__y", "__known": "__k", "__logs": "__l"})
        rows = rows.join(counted, F.col("__id").eqNullSafe(F.col("__i")) & F.col("__x").eqNullSafe(F.col("__y")))
    return rows.select(
        *[F.col(f"`{c}`") for c in carry],
        F.col("__n").alias("n_tokens"),
        F.col("__k").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__l") - F.col("__n") * F.lit(base)).alias("base_score"),
        (F.col("__l") + F.col("__c")).alias("score"),
    )


def lm_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (7, 2), carry: list[str] | None = None, broadcast_types: int = 6_000_000) -> DataFrame:
    """Train on the documents outside the held-out fold and score all; held_out says which fold a document is in."""
    of, out = held_out
    model = fit(docs.where(fold(F.col(doc_id), of) != out), text=text)
    carry = docs.columns if carry is None else carry
    marked = docs.withColumn("held_out", fold(F.col(doc_id), of) == out)
    return score(marked, model, doc_id=doc_id, text=text, carry=[*[c for c in carry if c.lower() != "held_out"], "held_out"], broadcast_types=broadcast_types)
