"""Masking of entities in texts: spans found by an Arrow function, their union and the replacement by column expressions.

A span is a struct of start, end (code points, end excluded) and kind. Spans that overlap or touch are merged into one, which
has the kind of the span that begins first, and of those the longest one. Masking never decides anything: it's a
helper for texts that people look at.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def spans_of(text: Column, load: Callable[[], Callable[[str], list[tuple[int, int, str]]]]) -> Column:
    """The spans that a finder reports; null where the text is null or the finder fails. load() makes it once a task."""
    made: list = []

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            try:
                if not made:
                    made.append(load())
                return [{"start": a, "end": b, "kind": k} for a, b, k in made[0](value)]
            except Exception:  # whatever a finder raises, its text isn't shown
                return None

        return texts.map(one)

    return found(text)


def pattern_finder(kinds: dict[str, str], seconds: float = 0.025):
    """A loader of a finder of what patterns match, one pattern a kind, with a limit of time for each search."""

    def load():
        import regex

        compiled = [(kind, regex.compile(pattern, regex.I)) for kind, pattern in kinds.items()]
        return lambda text: [(m.start(), m.end(), kind) for kind, c in compiled for m in c.finditer(text, timeout=seconds * (1 + len(text) // 16_000)) if m.end() > m.start()]

    return load


def merged(spans: Column) -> Column:
    """The union of spans, in order, disjoint and not touching. Empty and inverted spans are dropped."""
    real = F.filter(spans, lambda s: s["end"] > s["start"])
    ordered = F.array_sort(real, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))
    kind = lambda s, end: F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))

    def swept(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(kind(last, F.greatest(last["end"], s["end"]))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(kind(s, s["end"]))))

    return F.aggregate(ordered, F.array().cast(SPANS), swept)


def masked(text: Column, spans: Column) -> Column:
    """The text with each merged span replaced by its kind in angle brackets; null where spans are."""
    whole = merged(spans)
    # each span's mask with the plain text before it; what follows the last comes at the end
    before = lambda s, i: F.coalesce(F.get(whole, i - 1)["end"], F.lit(0))
    parts = F.transform(whole, lambda s, i: F.concat(F.substring(text, before(s, i) + 1, s["start"] - before(s, i)), F.lit("<"), s["kind"], F.lit(">")))
    rest = F.substring(text, F.coalesce(F.get(whole, F.size(whole) - 1)["end"], F.lit(0)) + 1, F.length(text))
    return F.when(spans.isNotNull(), F.concat(F.array_join(parts, ""), rest))


def mask(df: DataFrame, load: Callable, *, text: str = "text", out: str = "masked") -> DataFrame:
    """Adds the masked text; null where it couldn't be masked. Nothing else of a row changes."""
    # one-element explodes keep the optimiser from copying the function call
    found = df.select("*", F.explode(F.array(F.struct(spans_of(F.col(text), load).alias("s")))).alias("__spans"))
    return found.withColumn(out, masked(F.col(text), F.col("__spans.s"))).drop("__spans")
