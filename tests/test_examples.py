"""The hand-written examples, compared with the engine and for their own completeness."""

import duckdb
from pyspark.sql import functions as F

from palisade.plans.examples import CATEGORIES, EXAMPLES
from palisade.plans.queries import QUERIES
from palisade.plans.sql import SQL
from palisade.policies import BUILT_IN, REASONS


def test_examples_cover_every_policy():
    expected = {c for _, _, codes in EXAMPLES if codes for c in codes.split(",")}
    assert expected == {c for c, _, _ in BUILT_IN}
    assert len({n for n, _, _ in EXAMPLES}) == len(EXAMPLES)
    assert {c: reason for reason, codes in CATEGORIES.items() for c in codes.split()} == {c: REASONS[k] for c, k, _ in BUILT_IN}


def test_examples_woven_into_a_table(spark, tmp_path):
    """One part for each example, and two for most."""
    parts = spark.range(2 * len(EXAMPLES) - 9).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "old rod").otherwise("blue gear").alias("p_name"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("policy_cues", "variant_cues", "adapted_cues"):
        rows = QUERIES[name](spark, str(tmp_path))
        expected = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(expected, key=repr), name


def test_blank_prompts_are_no_requests(spark):
    from palisade.operators.gateway import valid_prompts

    rows = [(t,) for t in (" \t\n", "  ", " \u0085", "\x1c\x1f", "", None, " a ", "​", "x" * 16000, "x" * 16001)]
    kept = {r["prompt"] for r in valid_prompts(spark.createDataFrame(rows, "prompt string")).collect()}
    assert kept == {t for (t,) in rows if t and t.strip() and len(t) <= 16000}
