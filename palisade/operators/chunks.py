"""Overlapping windows of located text units, inspected one by one and across units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decide import analyze

WIDTH, STRIDE = 8000, 7500


def windows(text: Column, width: int = WIDTH, stride: int = STRIDE) -> Column:
    """Array of (offset, chunk): a window starts at each multiple of stride inside the text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(text, s + 1, F.lit(width)).alias("chunk")))


def chunked(units: DataFrame, text: str = "text", width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """One row for each window of each unit, with offset, characters and chunk in place of the text."""
    rest = [c for c in units.columns if c != text]
    rows = units.select(*rest, F.explode(windows(F.col(text), width, stride)).alias("w"))
    return rows.select(*rest, F.col("w.offset").alias("offset"), F.length("w.chunk").alias("characters"), F.col("w.chunk").alias("chunk"))


def joined_units(units: DataFrame, key: str = "doc", order: str = "ord", text: str = "text") -> DataFrame:
    """The units of each document as one text, joined by newlines in order, so that a secret cut by a boundary shows.

    A document has at most as many units as extraction allows, which bounds the group.
    """
    listed = F.sort_array(F.collect_list(F.struct(order, text)))
    return units.groupBy(key).agg(F.array_join(F.transform(listed, lambda u: u[text]), "\n").alias(text))


def inspect_units(units: DataFrame, documents: DataFrame, *, key: str = "doc", **options) -> DataFrame:
    """One report for each document: decision, complete, findings, issues and counts of decisions.

    units: key, ord, location, text. documents: key and issues (array of strings), one row for each document.
    """
    single = analyze(chunked(units.select(key, "location", "ord", "text")), "chunk", **options)
    across = analyze(chunked(joined_units(units, key)), "chunk", **options).where("analysis.decision = 'BLOCKED'")
    finding = lambda location, order, characters: F.struct(order.alias("ord"), F.col("offset"), location.alias("location"), characters.alias("characters"), F.col("analysis"))
    rows = single.select(key, finding(F.col("location"), F.col("ord").cast("long"), F.col("characters")).alias("f"))
    rows = rows.unionByName(across.select(key, finding(F.lit("cross-unit text"), F.lit(1 << 40).cast("long"), F.lit(None).cast("int")).alias("f")))
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list("f")).alias("findings"))
    out = documents.join(grouped, key, "left").withColumn("findings", F.coalesce("findings", F.array().cast(grouped.schema["findings"].dataType)))
    broken = F.exists("findings", lambda f: F.array_contains(f["analysis"]["safe_detection_summary"], "Security validation unavailable"))
    none = F.size("findings") == 0
    more = F.concat(F.when(none, F.array(F.lit("No extractable text"))).otherwise(F.array().cast("array<string>")), F.when(broken, F.array(F.lit("One or more detectors were unavailable"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("issues", F.concat(F.sort_array(F.array_distinct("issues")), more))
    complete = ~none & (F.size("issues") == 0)
    allowed = F.forall("findings", lambda f: f["analysis"]["decision"] == "ALLOWED")
    count = lambda d: F.size(F.filter("findings", lambda f: f["analysis"]["decision"] == d))
    return out.withColumn("complete", complete).withColumn("decision", F.when(complete & allowed, "ALLOWED").otherwise("BLOCKED")).withColumn("n_allowed", count("ALLOWED")).withColumn("n_blocked", count("BLOCKED"))
