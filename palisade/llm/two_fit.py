"""Best-two-fit packing of a whole corpus into as few token sequences as it can.

Documents of one length are alike to a packer, so the packing is planned on the number of pieces of each length, of
which there are at most `length`: that table alone reaches the driver, whatever the corpus. A sequence is filled greedily,
the longest piece that fits first; then its smallest piece is exchanged for two unpacked pieces that fill the gap more
tightly, as often as that helps. The next sequence would be filled alike for as long as its lengths last, so
a pattern is planned once with the number of times that it repeats. Places are then dealt to the pieces of each length by
rank: a task numbers its own pieces, and a running sum over tasks gives where its numbers begin. Ids are never shuffled.

Only documents of over `length` tokens are cut: into full pieces, the first of which may be shorter. A document is the
ids of a public byte-level tokenizer (its file is a parameter), then the end id.

Defined results: a null or empty text is its end id alone. Ids of rows are carried as they are, nulls and repeated ones
too. An empty table gives no pieces. Text that looks like a special token is ordinary text. Which of several equally
long pieces takes which place follows the input's partitions; the number of sequences doesn't. Other columns of the
input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, short_batches, staged
from .packing import RANKS, Tokens

#: Where the tokenizer lies on every machine, unless the caller names another place.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END = 0
#: A word with the one space before it, or white space that belongs to no word. The pre-tokenisation never crosses these.
#: Python's \s holds U+001C to U+001F, which the tokenizer's doesn't.
_UNIT = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
#: Characters outside ASCII, the Latin blocks (without their two spaces) and common punctuation.
_OTHER = re.compile("[^\\x00-\\x7f\\u00a1-\\u024f\\u2010-\\u2027]")


class _Known(dict):
    """Ids of units, encoded when first asked for. Two generations bound it: what an old one still gives lives on."""

    def __init__(self, encode: Callable[[str], bytes], keep: int):
        self.encode, self.keep, self.old = encode, keep, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit) or self.encode(unit)
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def shrink(self) -> None:
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()


class UnitIds:
    """Ids of texts as little-endian uint32. Most texts repeat their words, so the ids of a unit are kept.

    What counts as a letter, a digit or a space has long been settled for ASCII, the Latin letters and their punctuation:
    units of these get the same ids from the same vocabulary as ranks, by a faster library. The tokenizer's own library
    encodes all others. Where many units are new, as in texts of made-up words, keeping them costs more than it
    saves: then settled texts are encoded whole, and one of 32 still tells how many units are new.
    """

    def __init__(self, path: str = TOKENIZER, ranks: str = RANKS, keep: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain, whole = Tokens(ranks).encoding.encode_ordinary, self.tokenizer.encode

        def encode(unit: str) -> bytes:
            self.new += 1
            settled = unit.isascii() or not _OTHER.search(unit)
            return array("I", self.plain(unit) if settled else whole(unit, add_special_tokens=False).ids).tobytes()

        self.known, self.new, self.share, self.turn = _Known(encode, keep), 0, 0.0, 0

    def encode(self, text: str | None) -> bytes:
        self.turn += 1
        if self.share > 0.08 and self.turn % 32 and text and (text.isascii() or not _OTHER.search(text)):
            return array("I", self.plain(text)).tobytes()
        self.known.shrink()
        units, before = _UNIT.findall(text or ""), self.new
        ids = b"".join(map(self.known.__getitem__, units))
        if len(units) > 50:
            self.share += ((self.new - before) / len(units) - self.share) / 16
        return ids


def cuts(size: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: full ones but for the first."""
    first = (size - 1) % length + 1
    return [(0, first), *[(at, at + length) for at in range(first, size, length)]]


def plan_sequences(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (repeats, [(piece length, uses), ...] by falling length) that use up the pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    there = 0  # bit n: pieces of length n are left
    for n in left:
        there |= 1 << n

    def take(n: int) -> None:
        nonlocal there
        left[n] -= 1
        if not left[n]:
            there ^= 1 << n

    def give(n: int) -> None:
        nonlocal there
        left[n] = left.get(n, 0) + 1
        there |= 1 << n

    def largest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def best_pair(room: int) -> tuple[int, int] | None:
        """Two pieces that are left and fill the room best."""
        best, x = None, largest(room - 1)
        while x > 0 and 2 * x > (sum(best) if best else 0):
            y = largest(min(x if left[x] > 1 else x - 1, room - x))
            if y > 0 and (best is None or x + y > sum(best)):
                best = (x, y)
                if x + y == room:
                    break
            x = largest(x - 1)
        return best

    out = []
    while there:
        members, gap = [], length
        while (n := largest(gap)) > 0:
            take(n)
            members.append(n)
            gap -= n
        while gap and len(members) > 1:
            smallest = min(members)
            give(smallest)
            pair = best_pair(gap + smallest)
            if pair is None or sum(pair) <= smallest:
                take(smallest)
                break
            members.remove(smallest)
            for n in pair:
                take(n)
                members.append(n)
            gap += smallest - sum(pair)
        uses = Counter(members)
        again = min(left[n] // u for n, u in uses.items())
        for n, u in uses.items():
            left[n] -= again * u
            if not left[n]:
                there &= ~(1 << n)
        out.append((1 + again, sorted(uses.items(), reverse=True)))
    return out


class Places:
    """Sequence and offset of the piece of a length and rank."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        rows, ranks, first = [], Counter(), 0
        for repeats, members in patterns:
            offset = 0
            for n, uses in members:
                rows.append((n, ranks[n], uses, offset, first))
                ranks[n] += repeats * uses
                offset += n * uses
            first += repeats
        rows.sort()
        self.n_sequences = first
        self.size, self.rank, self.uses, self.offset, self.first = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [[]] * 5))
        self.key = (self.size << 48) + self.rank

    def find(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (sizes.astype(np.int64) << 48) + ranks, side="right") - 1
        nth = ranks - self.rank[at]
        return self.first[at] + nth // self.uses[at], self.offset[at] + nth % self.uses[at] * sizes


def token_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 2048, tokenizer: str = TOKENIZER, ranks: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, the task that made it and its rank there among its length.

    keep_ids adds the ids themselves (little-endian uint32).
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    fields = [rows.schema["doc_id"], *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("rank", T.LongType()))]]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, task, units, seen = to_arrow_schema(schema), TaskContext.get().partitionId(), UnitIds(tokenizer, ranks), Counter()
        end = np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for row, value in enumerate(batch.column(1)):
                    ids = units.encode(value.as_py()) + end
                    for piece, (start, stop) in enumerate(cuts(len(ids) // 4, length)):
                        own, n = ids[4 * start : 4 * stop], stop - start
                        out.append((row, piece, start, n, zlib.crc32(own), task, seen[n], *([own] if keep_ids else [])))
                        seen[n] += 1
                if out:
                    row, *columns = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(c, f.type) for c, f in zip(columns, list(target)[1:])]], schema=target)
        del units
        release()

    return rows.mapInArrow(run, schema)


def pack_two_fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 2048, tokenizer: str = TOKENIZER, ranks: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """One row a piece with sequence_id and offset, the place of its first id in that sequence."""
    if not 0 < length < 1 << 15:
        raise ValueError("1 to 32767 tokens a sequence")
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, doc_id=doc_id, text=text, length=length, tokenizer=tokenizer, ranks=ranks, keep_ids=keep_ids), "fit-pieces")
    counted = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "fit-counts")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan_sequences(counts, length)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = pieces.join(begins, ["task", "length"])
    carried = [c for c in pieces.columns if c not in ("task", "rank")]
    ready = ranked.select(*carried, (F.col("begin") + F.col("rank")).alias("nth"))
    schema = T.StructType([*[ready.schema[c] for c in carried], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.find(b.column("length").to_numpy(), b.column("nth").to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ready.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ids: sequence_id, input_ids (uint32), doc_ids, pieces and segment lengths, in order.

    A group is one sequence, so it holds at most its tokens.
    """
    members = F.sort_array(F.collect_list(F.struct("offset", "length", "piece", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(members.alias("m"))
    joined = F.aggregate("m", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("input_ids"), F.col("m.doc_id").alias("doc_ids"), F.col("m.piece").alias("pieces"), F.col("m.length").alias("lengths"))
