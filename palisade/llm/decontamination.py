"""Benchmark decontamination by a prefix-filtered set join.

An item is covered by windows of `window` consecutive words; an item of fewer words is one window. Containment of
a window must be whole, so one prefix token is necessary and enough: the window's rarest word. Corpus counts give
the rarity order. The rarest words are joined with the words of every document, the window's place in the item
bounds where it can lie in the document (it must neither start before the first word nor end after the last), and
the remaining places are verified word by word.

The index holds the items, which are the query set. It goes to the executors in blocks of at most `block_words`
words, so a block's size is bounded whatever the number of items; each block is one more row-wise pass over the
documents, without any shuffle.

Defined results: a null or empty text has no words, no hits and isn't contaminated. Null or empty items have no
windows. A null item id is listed as the empty string. Repeated items count once by their id; repeated documents
are judged one by one. An empty item table hits nothing. Input columns named like a result column are
replaced; columns named spans or items are dropped.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words_of, map_columns

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ITEMS = T.ArrayType(T.StringType())


def _windows(words: list[bytes], window: int) -> list[list[bytes]]:
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []


def _item_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int):
    """Blocks of (id, words), streamed from the item table; only one block is held at a time."""
    block, held = [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator(prefetchPartitions=True):
        words = alnum_words_of(row[1])
        if words:
            block.append((row[0] or "", words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _rarity(docs: DataFrame, text: str, vocabulary) -> dict[bytes, int]:
    """Occurrences in all documents of the words of one block (bounded by the block)."""

    def counts(batches):
        words, seen = vocabulary.value, Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for w in alnum_words_of(value):
                    if w in words:
                        seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    each = docs.select(F.col(text)).mapInArrow(counts, "w binary, n long")
    return {bytes(r[0]): r[1] for r in each.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def _index(block: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int):
    """Rarest word -> [(its place in the window, the window, ids of items)]."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for key, words in block:
        for win in _windows(words, window):
            owners[tuple(win)].add(key)
    index = defaultdict(list)
    for win, ids in owners.items():
        at = min(range(len(win)), key=lambda i: (counts.get(win[i], 0), win[i], i))
        index[win[at]].append((at, list(win), sorted(ids)))
    return dict(index)


def _matcher(index: dict, with_spans: bool):
    """A function from a text, its spans and items so far, to those with this index's."""

    def matches(value, before, owners):
        words = alnum_words_of(value)
        n, found, ids = len(words), {(s["start"], s["end"]) for s in before or []}, set(owners or [])
        seen = set()
        for i, w in enumerate(words):
            for window_of in index.get(w, ()):
                at, win, its = window_of
                start = i - at
                end = start + len(win)
                if start >= 0 and end <= n and words[start:end] == win:
                    found.add((start, end))
                    if id(window_of) not in seen:
                        seen.add(id(window_of))
                        ids.update(its)
        spans = sorted(found)
        return n, [{"start": a, "end": b} for a, b in spans] if with_spans else spans, sorted(ids)

    return matches


def _found(docs: DataFrame, items: DataFrame, *, text: str, item_id: str, item_text: str, window: int, block_words: int, carry: list[str], last: list[T.StructField], make_last) -> DataFrame:
    """The rows of docs after one pass for each block of items. The last pass appends the columns `last` instead of spans and items.

    make_last() returns the function from (n words, spans, items) to those columns. Each pass is one map, so that a
    task keeps one Python worker for each block.
    """
    spark = docs.sparkSession
    kept = [c for c in carry if c.lower() not in ("spans", "items")]
    need = kept if text in kept else [*kept, text]
    out = docs.select(*[F.col(f"`{c}`") for c in need], F.lit(None).cast(_SPANS).alias("spans"), F.lit(None).cast(_ITEMS).alias("items"))
    blocks = iter(_item_blocks(items, item_id, item_text, block_words))
    block = next(blocks, [])
    while True:
        coming = next(blocks, None)
        vocabulary = spark.sparkContext.broadcast({w for _, words in block for w in words})
        shared = spark.sparkContext.broadcast(_index(block, _rarity(docs, text, vocabulary) if block else {}, window))
        vocabulary.destroy()

        def make(shared=shared, final=coming is None):
            matches, judge = _matcher(shared.value, not final), make_last()

            def run(cols):
                rows = [matches(*row) for row in zip(*(c.to_pylist() for c in cols))]
                if final:
                    judged = [judge(*r) for r in rows]
                    return [list(c) for c in zip(*judged)] if judged else [[] for _ in last]
                return [[r[1] for r in rows], [r[2] for r in rows]]

            return run

        if coming is None:
            return map_columns(out, [text, "spans", "items"], kept, last, make)
        out = map_columns(out, [text, "spans", "items"], need, [T.StructField("spans", _SPANS), T.StructField("items", _ITEMS)], make)
        block = coming


def find_item_spans(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 2_000_000, carry: list[str] | None = None) -> DataFrame:
    """Every document with `spans`, the word ranges (start, end) where a window of an item occurs, and the ids of those items.

    A range is listed once, and so is an id, however many items share a window and however often it occurs.
    """
    listed = lambda n, spans, ids: ([{"start": a, "end": b} for a, b in spans], ids)
    last = [T.StructField("spans", _SPANS), T.StructField("items", _ITEMS)]
    return _found(docs, items, text=text, item_id=item_id, item_text=item_text, window=window, block_words=block_words, carry=docs.columns if carry is None else carry, last=last, make_last=lambda: listed)


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, min_share: tuple[int, int] = (1, 20), block_words: int = 2_000_000, carry: list[str] | None = None) -> DataFrame:
    """Every document with n_words, n_hit, n_items, items_sha256 and contaminated.

    n_hit counts the words inside any occurrence of a window; a document is contaminated if there is a hit and
    n_hit / n_words reaches min_share.
    """
    carry = docs.columns if carry is None else carry
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    share, of = min_share

    def judge(n, spans, ids):
        hit, end = 0, 0
        for start, stop in spans:
            hit += max(0, stop - max(start, end))
            end = max(end, stop)
        return n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and of * hit >= share * n

    return _found(docs, items, text=text, item_id=item_id, item_text=item_text, window=window, block_words=block_words, carry=carry, last=fields, make_last=lambda: judge)
