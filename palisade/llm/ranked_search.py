"""Ranked lexical search with a two-level quantised index.

The index holds every term of every document in blocks of documents: one row for each block and term, with the places of
the documents in the block, a byte for each (first level) and the exact number of occurrences (second level). The byte
is the term's impact in that document, rounded upward to 255 steps, so a sum of bytes bounds a score from above and,
a step lower, from below. A query reads the first level of its terms alone and keeps the documents whose upper bound
reaches the k-th best lower bound; only those are scored exactly, in integers, from the second level. No document that
could be among the k best is left out, so the answer is the exact one.

A block is bounded in documents and terms, so a very common term is one short row a block and no list of all its
documents exists anywhere. What is shuffled for the bounds is the bytes of the queries' terms, by block; a task keeps
the k best lower bounds that it has met, so that its later blocks emit little. Queries come in blocks of a bounded
number of terms; the index is read once for each.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. A term's weight is
w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 75 + 25 n N div L; a score sums w times
(10^9 tf) div (1000 tf + 12 m) over a query's terms, repeats included.

Defined results: a null or empty text has no terms and is never found; a query without a known term finds nothing.
Repeated rows are ranked one by one, and so are repeated queries. Ids may be null: among equal scores they come last.
Scores of 0 aren't found. An empty table of documents or queries gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words_of, release, short_batches, staged

#: Impacts without their weight are below this (fixed value of the score).
_TOP = 1_000_000
_STEPS = 255
#: Upper and lower bounds of an impact, by its byte.
_UPPER = np.arange(_STEPS + 1, dtype=np.int64) * _TOP // _STEPS
_LOWER = np.concatenate([[0], _UPPER[:-1] + 1])


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + (25 * n * n_docs) // max(n_terms, 1)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def corpus_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """How many documents have a term, and how many terms there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for value in batch.column(0):
                n = len(alnum_words_of(value.as_py()))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        release()
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    short_batches(docs.sparkSession)
    sums = docs.select(F.col(f"`{text}`")).mapInArrow(run, "n_docs long, n_terms long").agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).head()
    return sums["d"] or 0, sums["t"] or 0


def _binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of an array's bytes: slice i goes from element starts[i] to starts[i + 1]."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class _Block:
    """The documents of a block that are yet to be written."""

    def __init__(self):
        self.ids, self.lengths, self.vocabulary, self.terms = [], [], {}, []

    def add(self, doc_id, words: list[bytes]) -> None:
        vocabulary = self.vocabulary
        self.terms.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64))
        self.ids.append(doc_id)
        self.lengths.append(len(words))

    def rows(self, block: int, n_docs: int, n_terms: int, id_type: pa.DataType) -> Iterator[dict[str, pa.Array]]:
        lengths = np.array(self.lengths, dtype=np.int64)
        places = np.repeat(np.arange(len(lengths)), lengths)
        keys, tfs = np.unique(np.concatenate(self.terms) * len(lengths) + places, return_counts=True)
        term, place = np.divmod(keys, len(lengths))
        impacts = impact(tfs.astype(np.int64), length_norm(lengths, n_docs, n_terms)[place])
        starts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])
        names = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        levels = [_binaries(place.astype("<u2"), starts), _binaries(((impacts * _STEPS + _TOP - 1) // _TOP).astype(np.uint8), starts), _binaries(tfs.astype("<u4"), starts)]
        none = lambda n, kind: pa.nulls(n, kind)
        yield {"block": pa.array([block]), "term": none(1, pa.string()), "n_docs": pa.array([len(lengths)]), "places": none(1, pa.binary()), "impacts": none(1, pa.binary()), "tfs": pa.array([lengths.astype("<i8").tobytes()]), "doc_ids": pa.array([self.ids], pa.list_(id_type))}
        for at in range(0, len(names), 8192):
            n = min(8192, len(names) - at)
            part = [x.slice(at, n) for x in levels]
            yield {"block": pa.array(np.full(n, block)), "term": names.slice(at, n), "n_docs": pa.array(np.diff(starts)[at : at + n]), "places": part[0], "impacts": part[1], "tfs": part[2], "doc_ids": none(n, pa.list_(id_type))}


class Index:
    """A staged index: `table` has a row for each block and term, and one without a term for a block's documents."""

    def __init__(self, table: DataFrame, n_docs: int, n_terms: int):
        self.table, self.n_docs, self.n_terms = table, n_docs, n_terms


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_docs: int = 4096, block_terms: int = 1_000_000) -> Index:
    """Index every row. A block holds at most block_docs documents and is closed once it holds block_terms terms."""
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("places in a block are uint16")
    n_docs, n_terms = corpus_size(docs, text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    kinds = [("block", T.LongType()), ("term", T.StringType()), ("n_docs", T.LongType()), ("places", T.BinaryType()), ("impacts", T.BinaryType()), ("tfs", T.BinaryType()), ("doc_ids", T.ArrayType(rows.schema["d"].dataType))]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, first, number, open_ = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, 0, _Block()
        id_type = target.field("doc_ids").type.value_type

        def written(block: _Block) -> Iterator[pa.RecordBatch]:
            for part in block.rows(first + number, n_docs, n_terms, id_type):
                yield pa.RecordBatch.from_arrays([part[f.name].cast(f.type) for f in target], schema=target)

        held = 0
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                words = alnum_words_of(value.as_py())
                if not words:
                    continue
                open_.add(key.as_py(), words)
                held += len(words)
                if held >= block_terms or len(open_.ids) == block_docs:
                    yield from written(open_)
                    open_, held, number = _Block(), 0, number + 1
        if open_.ids:
            yield from written(open_)
        del open_
        release()

    return Index(staged(rows.mapInArrow(run, schema), "search-index"), n_docs, n_terms)


def _query_blocks(queries: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[list[tuple[object, Counter]]]:
    """(id, terms) of the queries, cut at block_terms terms. Rows come to the driver one partition at a time."""
    block, held = [], 0
    for row in queries.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        terms = Counter(w.decode() for w in alnum_words_of(row["t"]))
        block.append((row["i"], terms))
        held += len(terms)
        if held >= block_terms:
            yield block
            block, held = [], 0
    if block:
        yield block


def _bounds(uses: dict, n_queries: int, k: int):
    """The map from index rows, sorted by block, to (block, item, place, low, high) of documents that may be among the k best.

    uses: term -> (item numbers, weight times occurrences). What a task has met so far raises its bar: a document
    whose upper bound is under the k-th best lower bound met can't be among the k best of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best = uses.value, np.zeros((n_queries, k), dtype=np.int64)  # best lower bounds met, the least of them first

        def closed(rows: list[tuple[str, bytes, bytes]], block: int) -> Iterator[pa.RecordBatch]:
            postings = [(term, np.frombuffer(p, "<u2"), np.frombuffer(i, np.uint8)) for term, p, i in rows]
            size = 1 + max(int(p[-1]) for _, p, _ in postings)
            for start in range(0, n_queries, 256):  # bounds the two tables
                high = np.zeros((min(256, n_queries - start), size), dtype=np.int64)
                low = np.zeros_like(high)
                for term, place, byte in postings:
                    up, down = _UPPER[byte], _LOWER[byte]
                    items, weights = of[term]
                    for a in range(*np.searchsorted(items, (start, start + 256))):
                        high[items[a] - start, place] += weights[a] * up
                        low[items[a] - start, place] += weights[a] * down
                out = []
                for i in np.flatnonzero(high.max(axis=1)):
                    top = np.partition(low[i], -k)[-k:] if size > k else low[i]
                    best[start + i] = np.sort(np.concatenate([best[start + i], top]))[-k:]
                    at = np.flatnonzero(high[i] >= max(1, best[start + i, 0]))
                    out.append((np.full(len(at), start + i), at, low[i, at], high[i, at]))
                if out:
                    item, place, lows, highs = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), block)), pa.array(item.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(lows), pa.array(highs)], names=["block", "item", "place", "low", "high"])

        rows, block = [], None
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block and rows:
                    yield from closed(rows, block)
                    rows = []
                block = b
                rows.append(row)
        if rows:
            yield from closed(rows, block)

    return run


def _rescorer(uses: dict, n_docs: int, n_terms: int, id_type: T.DataType):
    """Exact scores of a block's candidates from its second level."""

    def score(candidates: pa.Table, rows: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        of, item, place = uses.value, candidates["item"].to_numpy(), candidates["place"].to_numpy()
        header, exact = None, np.zeros(len(item), dtype=np.int64)
        postings = []
        for row in rows.select(["term", "places", "tfs", "doc_ids"]).to_pylist():
            if row["term"] is None:
                header = row
            else:
                postings.append((row["term"], np.frombuffer(row["places"], "<u2"), np.frombuffer(row["tfs"], "<u4")))
        norm = length_norm(np.frombuffer(header["tfs"], "<i8"), n_docs, n_terms)[place]
        for term, places, tfs in postings:
            items, weights = of[term]
            asked = np.searchsorted(items, item)
            asks = (asked < len(items)) & (items[np.minimum(asked, len(items) - 1)] == item)
            found = np.minimum(np.searchsorted(places, place), len(places) - 1)
            both = np.flatnonzero(asks & (places[found] == place))
            exact[both] += weights[asked[both]] * impact(tfs[found[both]].astype(np.int64), norm[both])
        ids = pa.array([header["doc_ids"][p] for p in place.tolist()], to_arrow_type(id_type))
        return pa.table({"item": candidates["item"], "doc_id": ids, "score": pa.array(exact), "block": candidates["block"], "place": candidates["place"]})

    return score


def _search_block(index: Index, asked: list[tuple[object, Counter]], item_type: T.DataType, k: int) -> DataFrame:
    spark, table = index.table.sparkSession, index.table
    doc_type = table.schema["doc_ids"].dataType.elementType
    names = sorted({t for _, terms in asked for t in terms})
    # at most the terms of a block of queries
    terms = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(names, pa.string())}).to_pandas(), "term string") if names else spark.createDataFrame([], "term string"))
    known = {r["term"]: r["df"] for r in table.select("term", "n_docs").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
    uses: dict[str, tuple[list[int], list[int]]] = {}
    for number, (_, counted) in enumerate(asked):
        for term, times in counted.items():
            if term in known:
                items, weights = uses.setdefault(term, ([], []))
                items.append(number)
                weights.append(times * weight(known[term], index.n_docs))
    shared = spark.sparkContext.broadcast({t: tuple(np.array(x, dtype=np.int64) for x in u) for t, u in uses.items()})
    first = table.select("block", "term", "places", "impacts").join(terms, "term", "left_semi").select("block", "term", "places", "impacts")
    bounds = first.repartition("block").sortWithinPartitions("block").mapInArrow(_bounds(shared, len(asked), k), "block long, item int, place int, low long, high long")
    bounds = staged(bounds, "search-bounds")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    bar = bounds.select("item", "low", place.alias("r")).where(F.col("r") <= k).where(F.col("r") == k).select("item", F.col("low").alias("bar"))
    candidates = bounds.join(F.broadcast(bar), "item", "left").where(F.col("high") >= F.coalesce("bar", F.lit(0))).select("block", "item", "place")  # one row a query of the block
    candidates = staged(candidates, "search-candidates")
    second = table.select("block", "term", "places", "tfs", "doc_ids").join(candidates.select("block").distinct(), "block", "left_semi")
    second = second.where(F.col("term").isNull()).unionByName(second.where(F.col("term").isNotNull()).join(terms, "term", "left_semi").select(second.columns))
    kinds = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType()), T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType())])
    exact = candidates.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(_rescorer(shared, index.n_docs, index.n_terms, doc_type), kinds)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    ranked = exact.where("score > 0").select("item", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    numbers = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]))
    return ranked.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, *, item_id: str = "item_id", text: str = "text", k: int = 20, block_terms: int = 200_000) -> DataFrame:
    """The k best documents of each query: item_id, rank from 1, doc_id, score."""
    item_type, out = queries.schema[item_id].dataType, None
    for asked in _query_blocks(queries, item_id, text, block_terms):
        found = _search_block(index, asked, item_type, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        doc_type = index.table.schema["doc_ids"].dataType.elementType
        return queries.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]))
    return out
