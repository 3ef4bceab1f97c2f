"""Connected components by alternating stars: large ones, which pull far nodes in, and small ones, which flatten.

A chain of n nodes takes rounds in the order of log n, not n. Both stars are joins and aggregations over edges. A hub, a
node of very many edges, is one key of a join: where keys have more rows than a limit, their values go by broadcast,
which is bounded by the number of rows over that limit, and only the other keys are shuffled. Every round is written to the
shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged

#: Keys of more rows than this don't go through a shuffle.
HOT_ROWS = 1_000_000
#: At most so many keys go by broadcast.
HOT_KEYS = 100_000


def attach(rows: DataFrame, values: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the values of their key; values has one row a key. Keys of more than hot_rows rows are joined by broadcast."""
    heavy = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(key)
    hot = staged(values.join(heavy, key, "left_semi"), "hot-keys")
    n = hot.count()
    if not 0 < n <= HOT_KEYS:
        return rows.join(values, key)
    few = F.broadcast(hot)  # counted above
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key))


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return attach(both, least, "u", hot_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = attach(down, least, "u", hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, *, hot_rows: int = HOT_ROWS, most_rounds: int = 100) -> DataFrame:
    """node and root, the least node of its component, for every node of the edges (u, v). Self loops and repeated edges are fine."""
    alone = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    now, before = staged(edges.where("u <> v").select("u", "v"), "edges"), None
    for _ in range(most_rounds):
        large = staged(_large_star(now, hot_rows), "large-star")
        small = staged(_small_star(large, hot_rows), "small-star")
        discard(now, large)
        now = small
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    joined = members.unionByName(roots)
    return joined.unionByName(alone.join(joined.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
