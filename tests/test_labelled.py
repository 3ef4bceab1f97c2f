"""Queries over labelled documents judge those alone that their result needs."""

import pytest
from pyspark.sql import functions as F

from palisade.plans import queries
from palisade.policies import UNAVAILABLE


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i, f"my password is hunter{i}" if i % 2 else f"a quiet day {i}", "en", f"s{i % 3}") for i in range(12)]
    labels = [(i, 1, i % 4 // 3) for i in range(8)] + [(3, 1, 0), (99, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), {d: (s, t.startswith("my")) for d, t, _, s in docs}, [(d, t) for d, _, t in labels if d < 12]


def test_only_rows_with_the_label_are_judged(spark, tables, monkeypatch):
    folder, docs, labels = tables
    judged, real = [], queries.analyze

    def counted(df, *args, **options):
        judged.append(df.count())
        return real(df, *args, **options)

    monkeypatch.setattr(queries, "analyze", counted)
    by_source = {(r["source"], r["toxic"]): (r["n"], r["blocked"]) for r in queries.eval_by_source(spark, folder).collect()}
    codes = {r["code"]: r["false_blocks"] for r in queries.false_block_codes(spark, folder).collect()}
    sources = {r["source"]: r["false_blocks"] for r in queries.false_block_sources(spark, folder).collect()}
    allowed = [d for d, toxic in labels if toxic == 0]
    assert judged == [len(labels), len(allowed), len(allowed)]
    want = {}
    for d, toxic in labels:
        n, hit = want.get((docs[d][0], toxic), (0, 0))
        want[docs[d][0], toxic] = (n + 1, hit + docs[d][1])
    assert by_source == want
    wrong = [docs[d][0] for d in allowed if docs[d][1]]
    assert codes["PASSWORD"] == len(wrong)
    assert sources == {"lang en": len(wrong), **{s: wrong.count(s) for s in wrong}}


def test_workbook_metrics_judge_once(spark):
    """Each row's analysis is made once, however many figures there are."""
    from palisade.operators.evaluate import workbook_metrics

    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def blocked(sha):
        made.add(1)
        return sha in ("a", "b")

    rows = spark.createDataFrame(
        [("a", "BLOCKED"), ("a", "ALLOWED"), ("a", None), ("b", "BLOCKED"), ("c", "BLOCKED"), ("c", "BLOCKED"), ("d", None), (None, "ALLOWED"), (None, "BLOCKED")], "sha256 string, expected string"
    )
    # one-element explodes, as analyze has: no plan drops what makes them
    judged = rows.select("*", F.explode(F.array(F.struct(blocked("sha256").alias("b")))).alias("j"))
    decision = F.when(F.col("j.b"), "BLOCKED").otherwise("ALLOWED")
    reasons = F.when(F.col("sha256").isNull(), F.array(F.lit(UNAVAILABLE))).otherwise(F.array().cast("array<string>"))
    rows = judged.select("sha256", "expected", F.struct(decision.alias("decision"), reasons.alias("safe_detection_summary")).alias("analysis"))
    got = workbook_metrics(rows).collect()
    assert made.value == 9
    want = {"rows": 9, "labeled": 7, "matched": 3, "false_allowed": 3, "false_blocked": 1, "detector_errors": 2, "unique_prompts": 4, "conflicting_label_groups": 2, "accuracy": 3 / 7}
    assert [r.asDict() for r in got] == [want]
    assert [r.asDict() for r in workbook_metrics(rows.where("false")).collect()] == [dict.fromkeys(want, 0) | {"accuracy": None}]


def test_workbook_labels_move_no_text(spark, tables, monkeypatch):
    folder, docs, labels = tables
    judged, real = [], queries.analyze_distinct
    monkeypatch.setattr(queries, "analyze_distinct", lambda df, *a, **o: judged.append(df.columns) or real(df, *a, **o))
    (row,) = queries.workbook_metrics(spark, folder).collect()
    assert judged == [["doc_id", "text", "sha256"]]
    unlabelled = len(docs) - len({d for d, _ in labels})
    assert (row["rows"], row["labeled"], row["unique_prompts"]) == (len(labels) + unlabelled, len(labels), len(docs))
    assert row["matched"] == sum(docs[d][1] == bool(toxic) for d, toxic in labels)
