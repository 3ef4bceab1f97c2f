"""How corpus filters interact: what each removes in every order, alone, needlessly, and at what cost in good documents.

The word pipeline is relational: words are exploded, counted by (row, word), then by row for totals and distinct
words. The flags that need no words are joined to it by outer joins, and one aggregation counts, for each part of the
corpus, how many documents fail exactly each set of filters: 32 conditional counts for five filters, once for all
documents, once for good and once for toxic ones. Every order of the filters follows from those counts by arithmetic,
so no document is read once an order.

Texts are shuffled once, by (id, digest of the text), before they are exploded; both aggregations then find their rows
in place. One copy more of a text costs no more than its own words. What is joined and counted later is a few numbers a
document; the join by digest has one row a repeated text on its other side, so a text that a third of all documents
share only makes a large partition of small rows, which Spark's skew join splits.

Defined results: a null text is an empty one, and a null part the empty string. A null id is no smaller or larger than
any: such rows are never copies of an earlier document and have no labels. Repeated rows are counted one by one; rows
of one id and text aren't copies of each other. A document is good or toxic if any of its label rows says so. An empty
table gives an empty report. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

#: The five conditions of the standard audit, in the order of their bits.
FILTERS = "ABCDE"


def word_totals(rows: DataFrame) -> DataFrame:
    """n_words and n_distinct of each (id, digest) of rows (id, digest, t): explode, count words, count again."""
    # the empty string is no word: it counts the rows of an id and digest
    words = F.concat(F.array(F.lit("")), F.filter(F.split("t", SPACE), lambda w: w != ""))
    exploded = rows.repartition("id", "digest").select("id", "digest", F.explode(words).alias("word"))
    counted = exploded.groupBy("id", "digest", "word").agg(F.count("*").alias("n"))
    total, copies = F.sum(F.when(F.col("word") != "", F.col("n")).otherwise(0)), F.sum(F.when(F.col("word") == "", F.col("n")).otherwise(0))
    return counted.groupBy("id", "digest").agg(total.alias("words"), copies.alias("copies"), (F.count("*") - 1).alias("n_distinct")).select("id", "digest", (F.col("words") / F.col("copies")).cast("long").alias("n_words"), "n_distinct")


def filter_flags(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", min_words: int = 200, min_distinct_percent: int = 50, max_upper_percent: int = 3, symbols: str = "#$%&*|") -> DataFrame:
    """One row a document: id, part, n_words, n_distinct, good, toxic, and fails_A to fails_E.

    A: fewer than min_words words. B: fewer distinct words than the percentage. C: more capitals A-Z than the percentage
    of code points. D: holds one of the symbols. E: its text is that of a document of smaller id.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    holds = F.lit(False)
    for symbol in symbols:
        holds = holds | F.col("t").contains(symbol)
    capitals = F.regexp_count("t", F.lit("[A-Z]"))
    plain = staged(texts.select("id", "digest", "part", (100 * capitals.cast("long") > max_upper_percent * F.length("t").cast("long")).alias("fails_C"), holds.alias("fails_D")), "audit-flags")
    copied = plain.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("labelled")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    words = word_totals(texts.select("id", "digest", "t")).withColumnsRenamed({"id": "word_id", "digest": "word_digest"})
    joined = (
        plain.join(words, F.col("id").eqNullSafe(F.col("word_id")) & (F.col("digest") == F.col("word_digest")), "left")
        .join(copied, "digest", "left")
        .join(marks, F.col("id") == F.col("labelled"), "left")
    )
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    no = F.lit(False)
    return joined.select(
        "id", "part", n.alias("n_words"), distinct.alias("n_distinct"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"),
        (n < min_words).alias("fails_A"), (100 * distinct < min_distinct_percent * n).alias("fails_B"), "fails_C", "fails_D", F.coalesce(F.col("id") > F.col("first"), no).alias("fails_E"),
    )


def _mask(letters: Column, filters: str) -> Column:
    """The bits of the filters that a string names."""
    bits = F.lit(0)
    for i, letter in enumerate(filters):
        bits = bits + F.when(letters.contains(letter), 1 << i).otherwise(0)
    return bits


def interactions(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of every order and step, from boolean columns fails_<letter> (up to 6 letters), part, good and toxic.

    Columns: part, filter_order, step, and counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    if not 0 < len(filters) <= 6:
        raise ValueError("1 to 6 filters")
    sets = 1 << len(filters)
    code = F.lit(0)
    for i, letter in enumerate(filters):
        code = code + F.when(F.col(f"fails_{letter}"), 1 << i).otherwise(0)
    coded = flags.select("part", "good", "toxic", code.alias("code"))
    counted = coded.groupBy("part").agg(
        *[F.count_if(F.col("code") == s).alias(f"n{s}") for s in range(sets)],
        *[F.count_if((F.col("code") == s) & F.col(name)).alias(f"{name}{s}") for name in ("good", "toxic") for s in range(sets)],
    )
    arrays = counted.select("part", *[F.array(*[F.col(f"{name}{s}") for s in range(sets)]).alias(name) for name in ("n", "good", "toxic")])
    orders = ",".join("".join(p) for p in permutations(filters))
    steps = arrays.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    here = F.substring("filter_order", F.col("step"), F.lit(1))
    placed = steps.select("*", _mask(here, filters).alias("here"), _mask(F.substring("filter_order", F.lit(1), F.col("step") - 1), filters).alias("before"))

    def total(name: str, counts) -> Column:
        """The sum over the sets of failed filters that count."""
        return F.aggregate(F.transform(F.col(name), lambda n, s: F.when(counts(s), n).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)

    fails = lambda s: s.bitwiseAND(F.col("here")) != 0
    gone = lambda s: s.bitwiseAND(F.col("before")) != 0
    removed = lambda s: fails(s) & ~gone(s)
    # of all orders, an equal share has each of the failed filters first
    shares = F.array(*[F.lit(factorial(len(filters)) // max(1, s.bit_count())) for s in range(sets)])
    shapley = F.aggregate(F.transform(F.col("n"), lambda n, s: F.when(fails(s), n * F.get(shares, s)).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)
    return placed.select(
        "part", "filter_order", "step",
        total("n", lambda s: ~fails(s) & ~gone(s)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda s: fails(s) & gone(s)).alias("redundant"),
        F.get("n", F.col("here")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )
