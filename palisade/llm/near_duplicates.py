"""Near-duplicate classes by a multi-index Hamming join over minwise signatures.

A text is the set of its distinct shingles of `k` words. Equal sets, told by 128 bits of digest, are one node. A node's
signature has `chunks * width` symbols of 16 bits, each the low bits of a minwise hash. Two signatures that differ in
at most 2 * chunks - 1 symbols have, by the pigeonhole principle, a chunk with at most one error; so each chunk is
enumerated with each of its symbols left out, and such pairs always share a key. (At the least similarity, 0.75, a pair
has no common key with probability 0.3672 ** 10, under 1 in 20,000, with ten chunks of five.) Nodes with a common key
are a bucket; every link is confirmed on the full sets.

A group of copies never becomes all its pairs. The node that shares most of its keys leads its buckets, and each other
node of a bucket is compared with its leader only, which is linear in the nodes; the links give components. Only nodes of
buckets that still hold several components are open. Two open nodes of different components can be similar enough only
if they share one of their rarest shingles: with shingles in one order by rarity among the open nodes, a pair at the
threshold has a common shingle within the first places of both (prefix bound), late enough to leave room for the
overlap that both sizes ask for (positional bound). Shingles that one open node has alone come first and match nothing, so
edited copies of one text, far from each other, make no pairs. What these bounds leave is confirmed; what they exclude
has no link. Components come from repeated contraction; no link, component or set reaches the driver.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing, not even with another
such text; a text of fewer than k words has its whole sequence as one shingle. Rows with equal texts are one class,
repeated rows included. A null id is larger than any other. An empty table gives an empty result. Input columns
named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_columns, release, staged
from .shingles import Signer, _mix, set_digest, shingle_sets

_U = np.uint64
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 3 * i + 1, 1 << 64) for i in range(16)], dtype=_U)


def chunk_keys(signature: np.ndarray, chunks: int, width: int) -> np.ndarray:
    """The keys of a signature: each chunk with each one of its symbols left out."""
    terms = (signature.reshape(chunks, width) + _U(1)) * _STEPS[:width]
    marks = np.arange(1, chunks * width + 1, dtype=_U).reshape(chunks, width) * _STEPS[15]
    return _mix(terms.sum(axis=1, keepdims=True) - terms + marks).ravel()


def _halves(values: np.ndarray) -> tuple[int, int]:
    digest = set_digest(values)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signed(docs: DataFrame, doc_id: str, text: str, k: int, chunks: int, width: int) -> DataFrame:
    """(id, x, n, a, b, keys) of each row: x is the text's hash, a and b are the halves of the set's digest."""
    long = T.LongType()
    fields = [T.StructField("n", long), T.StructField("a", long), T.StructField("b", long), T.StructField("keys", T.ArrayType(long))]

    def make():
        signer = Signer(chunks * width)

        def run(cols):
            out: list[list] = [[] for _ in fields]
            for s in shingle_sets(cols[0].to_pylist(), k):
                row = (len(s), *_halves(s), chunk_keys(signer.sign(s), chunks, width).view(np.int64)) if len(s) else (0, None, None, None)
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    return map_columns(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("x"), F.col(text).alias("text")), ["text"], ["id", "x"], fields, make)


def _sets(docs: DataFrame, doc_id: str, text: str, k: int, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(node, members) of wanted(node, a, b, id, x): the set of the row with that id and text hash."""
    rows = wanted.select(F.col("id").alias("__w"), F.col("x").alias("__h"))
    rows = F.broadcast(rows) if rows.count() <= broadcast_rows else rows
    fields = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("members", T.BinaryType())]

    def make():
        def run(cols):
            sets = shingle_sets(cols[0].to_pylist(), k)
            halves = [_halves(s) if len(s) else (None, None) for s in sets]
            return [[h[0] for h in halves], [h[1] for h in halves], [s.tobytes() for s in sets]]

        return run

    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("x"), F.col(text).alias("text"))
    some = own.join(rows, F.col("id").eqNullSafe(F.col("__w")) & (F.col("x") == F.col("__h")), "left_semi")
    # a repeated row gives its set again
    return map_columns(some, ["text"], [], fields, make).dropDuplicates(["a", "b"]).join(wanted.select("node", "a", "b"), ["a", "b"]).select("node", "members")


def _listed(sets: DataFrame) -> DataFrame:
    """(node, s) for each shingle of each set."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                members = [np.frombuffer(m.as_buffer(), dtype=np.int64) for m in batch.column(1)]
                nodes = np.repeat(np.array(batch.column(0).to_pylist(), dtype=np.int64), [len(m) for m in members])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(members) if members else np.zeros(0, np.int64))], names=["node", "s"])
        release()

    return sets.select("node", "members").mapInArrow(run, "node long, s long")


def _prefixes(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, n, place, s): the shingles of open_(node, root, n) that open a prefix and that another one has too.

    place counts from 1 in the order by rarity among these nodes. A prefix ends where what follows is too little for the
    least overlap that a partner of at least the node's own size asks for.
    """
    rows = _listed(sets.join(open_.select("node"), "node", "left_semi"))
    counted = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("node").alias("one"))
    counted = staged(counted, "near-counts")
    alone = counted.where("df = 1").groupBy(F.col("one").alias("node")).agg(F.count("*").alias("own"))
    long = F.expr(f"n - ((n * {percent} + 99) div 100) + 1")
    able = staged(open_.join(alone, "node", "left").na.fill(0, ["own"]).where(F.col("own") < long), "near-able")
    common = counted.where("df > 1").select("s", "df")
    shared = _listed(sets.join(able.select("node"), "node", "left_semi")).join(common, "s")
    order = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))  # one document's shingles
    ranked = order.join(able, "node").select("node", "root", "n", "own", F.posexplode(F.slice("o", F.lit(1), (long - F.col("own")).cast("int"))).alias("at", "e"))
    return ranked.select("node", "root", "n", (F.col("own") + F.col("at") + 1).alias("place"), F.col("e.s").alias("s"))


def _near_prefixes(prefixes: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different roots that the prefix and positional bounds allow; u is the smaller set."""
    of = 100 + percent
    least = F.expr(f"(({percent} * (n + m)) + {of - 1}) div {of}")  # the overlap that both sizes ask for
    small = prefixes.where(f"place <= n - ((2 * {percent} * n + {of - 1}) div {of}) + 1").withColumnsRenamed({"node": "u", "root": "ru", "place": "pu", "s": "su"})
    large = prefixes.withColumnsRenamed({"node": "v", "root": "rv", "n": "m", "place": "pv"})
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("u") < F.col("v")))
    room = F.least(F.col("n") - F.col("pu"), F.col("m") - F.col("pv")) + 1 >= least
    sized = 100 * F.col("n") >= percent * F.col("m")
    met = small.join(large, (F.col("su") == F.col("s")) & (F.col("ru") != F.col("rv")) & ordered & sized & room)
    return met.select("u", "v").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have at least percent / 100 of their union in common."""
    left = sets.withColumnsRenamed({"node": "nu", "members": "mu"})
    right = sets.withColumnsRenamed({"node": "nv", "members": "mv"})
    both = pairs.join(left, F.col("u") == F.col("nu")).join(right, F.col("v") == F.col("nv")).select("u", "v", "mu", "mv")

    def check(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, ok = whole.slice(at, 256), []
                for a, b in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(a.as_buffer(), dtype=_U), np.frombuffer(b.as_buffer(), dtype=_U)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))
        release()

    return both.mapInArrow(check, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links(u, v): root is the least node of its component.

    Each round every node points to its least neighbour, pointers are followed twice, and the links between what
    they reach remain. Links and pointers are staged each round; the driver sees only whether links remain.
    """
    edges = staged(links.select("u", "v").where("u <> v").distinct(), "cc-links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.least("u", "m").alias("p"))
        least = staged(least, "cc-least")
        hop = least.select(F.col("a").alias("b"), F.col("p").alias("q"))
        far = least.join(hop, F.col("p") == F.col("b")).select("a", F.col("q").alias("p"))
        far = far.join(hop, F.col("p") == F.col("b")).select("a", F.col("q").alias("p"))
        far = staged(far, "cc-far")
        if roots is None:
            now = far.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            now = roots.join(far, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root"))
        before, roots = [edges, least, far, *([] if roots is None else [roots])], staged(now, "cc-roots")
        to = far.withColumnsRenamed({"a": "c", "p": "r"})
        edges = edges.join(far, F.col("u") == F.col("a")).join(to, F.col("v") == F.col("c")).select(F.col("p").alias("u"), F.col("r").alias("v")).where("u <> v")
        edges = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-links")
        discard(*before)
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classified(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, chunks: int, width: int, broadcast_rows: int) -> DataFrame:
    """(id, x, n, node, root, component) of each row: root, null for an empty set, is the least node of its component, component the least id."""
    rows = staged(_signed(docs, doc_id, text, k, chunks, width), "near-rows")
    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("id"), F.min(F.struct("id", "x")).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "id", F.struct(F.col("at.id").alias("id"), F.col("at.x").alias("x")).alias("at"), "n", "keys"), "near-nodes")

    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    bucketed = staged(keyed.join(several, "key", "left_semi"), "near-buckets")
    shared = staged(bucketed.groupBy("node").agg(F.count("*").alias("shared"), F.first("n").alias("n")), "near-shared")
    wanted = nodes.join(shared.select("node"), "node", "left_semi").select("node", "a", "b", "at.id", "at.x")
    sets = staged(_sets(docs, doc_id, text, k, wanted, broadcast_rows), "near-sets")

    # the leader of a bucket is the node that shares most of its keys: the one that its copies are nearest to
    ranked = bucketed.join(shared.select("node", "shared"), "node")
    lead = ranked.groupBy("key").agg(F.max(F.struct("shared", "node", "n")).alias("s")).select("key", F.col("s.node").alias("lead"), F.col("s.n").alias("m"))
    led = ranked.join(lead, "key").where(F.col("node") != F.col("lead")).where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    star = staged(led.select(F.greatest("node", "lead").alias("u"), F.least("node", "lead").alias("v")).distinct(), "near-star")
    links = staged(_confirmed(star, sets, percent), "near-links")
    first = components(links)

    # open are the nodes of buckets that still hold several components
    rooted = staged(bucketed.join(first, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    open_ = staged(rooted.join(mixed, "key", "left_semi").select("node", "root", "n").distinct(), "near-open")
    prefixes = staged(_prefixes(open_, sets, percent), "near-prefixes")
    met = _near_prefixes(prefixes, percent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    more = staged(met.join(star, ["u", "v"], "left_anti"), "near-more")
    if not more.isEmpty():
        links = staged(links.unionByName(_confirmed(more, sets, percent)), "near-links")
        first = components(links)

    rooted = nodes.join(first, "node", "left").select("node", "a", "b", "id", F.coalesce("root", "node").alias("root"))
    least_id = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = staged(rooted.join(least_id, "root").select("node", F.col("a").alias("__a"), F.col("b").alias("__b"), "root", "component"), "near-components")
    discard(nodes, bucketed, shared, sets, star, links, open_, prefixes, more)
    out = rows.join(named, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left")
    return out.select("id", "x", "n", "node", "root", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, chunks: int = 10, width: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, node, component_id and kept."""
    found = _classified(docs, doc_id, text, k, percent, chunks, width, broadcast_rows)
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "node", F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("id")).alias("kept"))


def without_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, chunks: int = 10, width: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each component, one of those with its least id, and all rows of empty sets, with the input's columns.

    Rows are told apart by id and text hash, since a null or repeated id can stand on several texts. Where several
    texts of a component have its least id, that of least hash stays. Rows that aren't the only ones of their component
    are few against the texts: their ids and hashes are taken out by an anti-join, broadcast only if there are at most
    broadcast_rows of them.
    """
    found = staged(_classified(docs, doc_id, text, k, percent, chunks, width, broadcast_rows).where("n > 0").select("id", "x", "root", F.col("component").eqNullSafe(F.col("id")).alias("least")), "near-found")
    several = staged(found.where("least").groupBy("root").agg(F.min("x").alias("stays"), F.count("*").alias("rows")).where("rows > 1").select("root", "stays"), "near-several")
    beaten = found.where("least").join(several, "root").where("x <> stays").select("id", "x")
    gone = staged(found.where("not least").select("id", "x").unionByName(beaten).distinct().select(F.col("id").alias("__id"), F.col("x").alias("__x")), "near-gone")
    repeated = staged(found.where("least").join(several, "root").where("x = stays").groupBy("id", "x").count().where("count > 1").select(F.col("id").alias("__id"), F.col("x").alias("__x")), "near-repeated")
    some = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__x"))
    left = docs.join(some, same, "left_anti")
    if repeated.isEmpty():
        return left
    twice = left.join(repeated, same, "left_semi").withColumn("__x", F.xxhash64(text)).dropDuplicates([doc_id, "__x"]).drop("__x")
    return left.join(repeated, same, "left_anti").unionByName(twice)
