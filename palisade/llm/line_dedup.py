"""Cross-site boilerplate lines by distinct-site spread, with DataFrame functions only.

A line is boilerplate if it stands on at least `min_sites` distinct sites. A HyperLogLog sketch of sites is kept
for each line hash; sketches merge by aggregation, on the map side first, so one very common line sends one sketch
from a task. Lines whose estimate lies within the sketch's error of the threshold get exact distinct counts; the
others are decided by the estimate. Boilerplate lines are then cut out of every document.

Only line hashes and sites are shuffled, never lines. The removed places join back to the documents by broadcast
if there are at most `broadcast_rows` of them, else by shuffle of the documents.

Defined results: lines are what stands between \\n; a line without a word (blank) is never boilerplate and stays.
A null text has no lines and stays null; an empty text stays empty. A null site counts as one site of its own. A
line repeated within a document goes everywhere or nowhere. Repeated rows are treated alike. An empty table gives an
empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged, without

FIELDS = ["n_lines", "n_removed", "clean_text"]


def line_spread(docs: DataFrame, *, text: str = "text", site: str = "source", min_sites: int = 8, log2_registers: int = 12) -> DataFrame:
    """The hashes of the lines that stand on at least min_sites sites."""
    error = 5 * 1.04 / 2 ** (log2_registers / 2)
    band = max(1.0, error * min_sites)
    name = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))
    lines = docs.select(name.alias("site"), F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.col("line").rlike(WORD)).select("site", F.xxhash64("line").alias("h"))
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(log2_registers)).alias("sketch"))
    rated = sketches.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= F.lit(min_sites - band))
    rated = staged(rated, "line-spread")
    near = rated.where(F.col("sites") <= F.lit(min_sites + band)).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    far = rated.where(F.col("sites") > F.lit(min_sites + band)).select("h")
    return far.unionByName(exact.select("h"))


def drop_boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8, carry: list[str] | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs with n_lines, n_removed and clean_text."""
    spread = staged(line_spread(docs, text=text, site=site, min_sites=min_sites), "lines")
    if spread.count() <= broadcast_rows:
        spread = F.broadcast(spread)
    # repeated rows of an id are told apart by their text's hash
    key = [F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__x")]
    places = docs.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("__at", "line")).where(F.col("line").rlike(WORD)).select("__id", "__x", "__at", F.xxhash64("line").alias("h"))
    cut = places.join(spread, "h", "left_semi").groupBy("__id", "__x").agg(F.collect_set("__at").alias("__cut")).withColumnsRenamed({"__id": "__i", "__x": "__y"})
    cut = staged(cut, "line-cuts")
    if cut.count() <= broadcast_rows:
        cut = F.broadcast(cut)
    keep = [f"`{c}`" for c in without(docs, FIELDS) if carry is None or c in carry]
    lines = F.split(F.col(text), "\n")
    rows = docs.select(*keep, *key, lines.alias("__lines"))
    joined = rows.join(cut, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__x") == F.col("__y")), "left")
    clean = F.when(F.col("__cut").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x, i: ~F.array_contains(F.col("__cut"), i)))
    return joined.select(*keep, F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__cut"), F.lit(0)).cast("long").alias("n_removed"), F.array_join(clean, "\n").alias("clean_text"))
