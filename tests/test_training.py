"""Training, its manifest, every refusal, and recalibration."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators import training
from palisade.operators.evaluate import CoverageError
from palisade.operators.training import TrainingError, checksum, load_model, recalibrate, score, train
from palisade.policies import LABELS
from palisade.session import shared_checkpoints

SCHEMA = "split string, text string, label string, provenance array<struct<source:string,original_split:string,row_split:string>>"
SMALL = {"features": 512, "max_iter": 5}


def rows():
    out = []
    for i in range(40):
        for k, label in enumerate(LABELS):
            split = "train" if i < 24 else "validation" if i < 32 else "test"
            out.append((split, f"word{k} word{k} common{i % 5} case {i} of {k}", label, [("s", split, split)]))
    return out


@pytest.fixture(scope="module")
def splits(spark):
    shared_checkpoints(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def trained(splits, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    return path, train(splits, path, caps={"train": 20, "validation": 6, "test": 100}, **SMALL)


def test_manifest_and_model(spark, splits, trained):
    path, manifest = trained
    assert manifest["labels"] == LABELS and manifest["seed"] == 42
    assert set(manifest["source_counts"]["train"].values()) == {24} and set(manifest["selected_counts"]["train"].values()) == {20}
    assert set(manifest["selected_counts"]["validation"].values()) == {6} and set(manifest["selected_counts"]["test"].values()) == {8}
    assert manifest["evaluation"]["accuracy"] > 0.9 and 0.5 <= manifest["decision_thresholds"] <= 1
    model, read = load_model(spark, path)
    assert read == json.loads(json.dumps(manifest))
    scored = score(model, splits.select("label", "text")).collect()
    assert all(len(r["scores"]) == 7 and sum(r["scores"]) == pytest.approx(1) for r in scored)
    assert sum(LABELS[max(range(7), key=r["scores"].__getitem__)] == r["label"] for r in scored) > 0.9 * len(scored)
    assert len(score(model, spark.createDataFrame([(None,), ("",)], "text string")).collect()) == 2


def test_checksum_is_of_the_records(splits):
    assert checksum(splits) == checksum(splits.orderBy("text").coalesce(1))
    assert len({checksum(splits), checksum(splits.limit(3)), checksum(splits.limit(0)), checksum(splits.unionByName(splits.limit(1))), checksum(splits.withColumn("label", F.lit("allowed")))}) == 5


def changed(spark, *more, without=lambda r: False):
    return spark.createDataFrame([r for r in rows() if not without(r)] + list(more), SCHEMA)


def test_refusals(spark, splits, tmp_path):
    out = str(tmp_path / "o")
    cases = [
        ("invalid", changed(spark, ("train", "x", "other", []))), ("invalid", changed(spark, ("train", None, "allowed", []))), ("invalid", changed(spark, ("dev", "x", "allowed", None))),
        ("leakage", changed(spark, ("test", "WORD0 word0  common0 case 0 of 0", "allowed", []))), ("evaluation data", changed(spark, ("train", "new", "allowed", [("s", "test", "train")]))),
        ("every label", changed(spark, without=lambda r: r[0] == "train" and r[2] == LABELS[3])), ("empty", changed(spark, without=lambda r: r[0] == "test")),
    ]
    for message, df in cases:
        with pytest.raises(TrainingError, match=message):
            train(df, out, **SMALL)
    with pytest.raises(TrainingError, match="positive"):
        train(splits, out, caps={"train": 0, "validation": 1, "test": 1})
    with pytest.raises(TrainingError, match="rate"):
        train(splits, out, rate=0.2)
    with pytest.raises(CoverageError):
        train(splits, out, unmapped=2000)
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    with pytest.raises(TrainingError, match="empty"):
        train(splits, str(tmp_path / "full"))
    assert not (tmp_path / "o").exists()


def test_recalibration(spark, splits, trained, tmp_path):
    path, manifest = trained
    again = recalibrate(splits, path, str(tmp_path / "r"), rate=0.1)
    assert set(again["decision_thresholds"]) == set(LABELS[1:]) and again["recalibrated"] and again["source_sha256"] == manifest["source_sha256"]
    assert load_model(spark, str(tmp_path / "r"))[1]["decision_thresholds"] == again["decision_thresholds"]
    for message, call in (
        ("changed", lambda: recalibrate(splits.where("text <> 'word0 word0 common0 case 0 of 0'"), path, str(tmp_path / "n"))),
        ("another folder", lambda: recalibrate(splits, path, path + "/")),
        ("isn't empty", lambda: recalibrate(splits, path, str(tmp_path / "r"))),
        ("no trained model", lambda: recalibrate(splits, str(tmp_path / "none"), str(tmp_path / "n"))),
    ):
        with pytest.raises(TrainingError, match=message):
            call()
    for name, broken in (("labels", LABELS[::-1]), ("decision_thresholds", {"blocked_pii": 0.9}), ("decision_thresholds", 0.2)):
        bad = str(tmp_path / f"bad-{name}-{len(str(broken))}")
        training._write_manifest(spark, bad, {**manifest, name: broken})
        with pytest.raises(TrainingError):
            recalibrate(splits, bad, str(tmp_path / "n"))
    assert not (tmp_path / "n").exists()


def test_rows_are_made_once(spark, splits, tmp_path):
    """Checks, counts, samples and checksums read staged rows, so costly splits are computed once."""
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    costly = splits.withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    train(costly, str(tmp_path / "m"), caps={"train": 20, "validation": 6, "test": 6}, **SMALL)
    assert made.value == splits.count()
