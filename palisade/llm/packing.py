"""Token ids in packed sequences: best-fit-decreasing packing with a segment tree over capacities.

Texts become token ids of a public byte-level tokenizer whose rank file is a parameter. A document longer than
a sequence is split losslessly: full sequences of its own, and a rest that is packed like any short document. The
pieces of one block (the rows of a task, cut at `block_tokens` tokens so that memory is bounded) are sorted by
falling length; each goes to the fullest sequence that still has room, found by a descent in a segment tree that is
indexed by free room; if none has room, a new sequence opens. Nothing is shuffled, dropped or truncated.

Each packed row holds `length` ids (the rest is padding), the cumulative segment lengths, position ids that start
again at 0 in each segment, and for each segment the document and the offset of its first id there.

Ids of any type are carried as they are. A block's name and fill follow the input's partitions: the same texts dealt
otherwise give other sequences, with the same ids in all.

Defined results: a null or empty text becomes its end mark alone. A null id is carried as null. Repeated rows are
packed one by one. An empty table gives no sequences. Text that looks like a special token is ordinary text.
Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, short_batches

#: Where the tokenizer's ranks lie on every machine, unless the caller names another place.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that belongs to these ranks (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id after the last rank: it marks the end of a document.
END = 50256


class Tokens:
    """Encodes columns of texts: each distinct word of a column once, with the space before it.

    The pre-tokenisation never crosses a space that begins a word, so words can be encoded in any order, many in one call
    (`keep` at most), and a text's ids are gathered from those of its words. A text in which a space stands before other
    white space or the end is encoded whole.
    """

    def __init__(self, ranks: str = RANKS, keep: int = 100_000):
        import tiktoken

        pairs = (line.split() for line in Path(ranks).read_bytes().splitlines() if line)
        tokens = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.keep, self.size = keep, np.zeros(max(tokens.values()) + 1, dtype=np.int64)
        self.size[list(tokens.values())] = [len(t) for t in tokens]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype=np.uint16)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with a space before each, and how many there are up to the end of each. No word begins with white space."""
        parts, ends, held = [], [], 0
        for at in range(0, len(words), self.keep):
            some = words.slice(at, self.keep)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            ids = self._ids(" " + joined)
            byte, stop = np.cumsum(self.size[ids]), np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            n = np.searchsorted(byte, stop) + 1
            if not np.array_equal(byte[n - 1], stop):
                raise ValueError("a token goes beyond its word")
            parts.append(ids)
            ends.append(held + n)
            held += len(ids)
        return np.concatenate(parts or [np.empty(0, np.uint16)]), np.concatenate(ends or [np.empty(0, np.int64)])

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and END; null is an empty text."""
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        bounds = bounds - bounds[:1]
        which, words = coded.indices.to_numpy(), coded.dictionary
        first = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
        odd = np.array([not c or c.isspace() for c in first.dictionary.to_pylist()], dtype=bool)[first.indices.to_numpy()]
        ids, ends = self._word_ids(words.filter(pa.array(~odd)))
        n, begin = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        n[~odd], begin[~odd] = np.diff(ends, prepend=0), np.concatenate([[0], ends])[:-1]

        bad, n = odd[which], n[which]
        bad[bounds[:-1]], n[bounds[:-1]] = False, 0  # what stands before the first space is encoded on its own
        whole, stop = np.concatenate([[0], np.cumsum(bad)]), np.concatenate([[0], np.cumsum(n)])
        gathered = ids[np.repeat(begin[which] - stop[:-1], n) + np.arange(stop[-1])]
        end, out = np.array([END], dtype=np.uint16), []
        for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if whole[a] < whole[b]:
                out.append(np.concatenate([self._ids(texts[row].as_py()), end]))
            else:
                out.append(np.concatenate([self._ids(words[which[a]].as_py()), gathered[stop[a] : stop[b]], end]))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(x) for x in ids if x != END])


class RoomTree:
    """Segment tree over free room 0..length: how many open sequences have each room, and the least room of at least n."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The fullest sequence with room for `need` ids, and its room; it is removed."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        sequence = self.open[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return sequence, room


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers. Every piece has 1..length ids."""
    tree, out = RoomTree(length), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[piece]
        found = tree.take(need)
        if found is None:
            out.append([])
            found = (len(out) - 1, length)
        sequence, room = found
        out[sequence].append(piece)
        if room > need:
            tree.put(room - need, sequence)
    return out


def packed_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("sequence", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("offsets", T.ArrayType(T.LongType())),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("input_ids", T.BinaryType()),
            T.StructField("position_ids", T.BinaryType()),
        ]
    )


def _packed(block: list[tuple[object, np.ndarray]], name: str, length: int) -> Iterator[tuple]:
    pieces = [(key, at, ids[at : at + length]) for key, ids in block for at in range(0, len(ids), length)]
    for number, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
        segments = [pieces[i] for i in members]
        ends = np.cumsum([len(s[2]) for s in segments], dtype=np.int32)
        ids = np.full(length, END, dtype="<u2")
        ids[: ends[-1]] = np.concatenate([s[2] for s in segments])
        places = np.zeros(length, dtype="<u2")
        places[: ends[-1]] = np.concatenate([np.arange(len(s[2])) for s in segments])
        yield name, number, [s[0] for s in segments], [s[1] for s in segments], [0, *ends.tolist()], int(ends[-1]), ids.tobytes(), places.tobytes()


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 2048, ranks: str = RANKS, block_tokens: int = 8_000_000) -> DataFrame:
    """Packed sequences of `length` ids (little-endian uint16 in input_ids and position_ids)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    schema = packed_schema(rows.schema["d"].dataType)
    short_batches(docs.sparkSession)
    if length > 65535:
        raise ValueError("position ids are uint16")

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, part, tokens, number = to_arrow_schema(schema), TaskContext.get().partitionId(), Tokens(ranks), 0

        def out(block):
            rows = []
            for row in _packed(block, f"{part}-{number}", length):
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)

        block, held = [], 0
        for batch in batches:
            for key, ids in zip(batch.column(0), tokens.encode_all(batch.column(1))):
                block.append((key.as_py(), ids))
                held += len(ids)
                if held >= block_tokens:
                    yield from out(block)
                    block, held, number = [], 0, number + 1
        if block:
            yield from out(block)
        del block, tokens
        release()

    return rows.mapInArrow(run, schema)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the packed rows: one id matrix row, its segment lengths and its position resets per record, as Parquet."""
    packed.write.mode("overwrite").parquet(path)
