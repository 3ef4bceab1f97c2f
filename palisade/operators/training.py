"""Training of the classifier stage from prepared splits, its manifest, and recalibration that refuses changed data.

The model is a Spark ML pipeline: hashed words and a multinomial logistic regression over the seven labels, in their fixed
order. Training takes a bounded, balanced sample by digest (the bound is a parameter); all checks cover every
record. Held-out test records are used once, after training and calibration.

A manifest says what a model was made from: checksums of the splits, label order, counts, thresholds and metrics. A split's
checksum doesn't depend on order, files or partitions: it's a hash of the count and of sums over the records' hashes.

Defined results: a record without text or with an unknown label is an error of the whole run, as are a text in two places,
evaluation data outside test, an empty split, a training split without one of the labels, and an output folder that
isn't empty. Nothing is written then.
"""

from __future__ import annotations

import json
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import folded_digest
from ..policies import LABELS
from ..session import discard, staged
from .evaluate import argmax_metrics, balanced_sample, bounded_sample, calibrated_metrics, class_thresholds, coverage_gate, single_threshold
from .prepare import SPLITS, provenance_allowed
from .scoring import valid_threshold

SEED = 42
MANIFEST = "training_manifest.json"


class TrainingError(ValueError):
    """Data or options that must not be trained on."""


def checksum(rows: DataFrame) -> str:
    """A hash of a set of (text, label) records."""
    digest = F.sha2(F.concat_ws("\0", "label", "text"), 256)
    # 60 bits of each quarter: sums stay exact in 38 digits up to 10^19 records
    quarters = [F.sum(F.conv(F.substring("d", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"q{i}") for i in range(4)]
    row = rows.select(digest.alias("d")).agg(F.count("*").alias("n"), *quarters)
    return row.select(F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row.columns]), 256)).head()[0]


def check_splits(splits: DataFrame, digest: str | None = None) -> None:
    """splits: split, text, label, provenance, and digest if it names the column of texts' folded digests. Raises what training refuses."""
    known = F.col("label").isin(LABELS) & F.col("text").isNotNull() & F.col("split").isin(SPLITS)
    stray = (F.col("split") != "test") & F.exists(F.coalesce("provenance", F.array().cast(splits.schema["provenance"].dataType)), lambda p: ~provenance_allowed(F.col("split"), p))
    found = splits.agg(F.coalesce(F.bool_or(~F.coalesce(known, F.lit(False))), F.lit(False)).alias("invalid"), F.coalesce(F.bool_or(stray), F.lit(False)).alias("stray")).head()
    if found["invalid"]:
        raise TrainingError("invalid training record")
    if found["stray"]:
        raise TrainingError("evaluation data outside the test split")
    if not splits.groupBy((F.col(digest) if digest else folded_digest(F.col("text"))).alias("d")).count().where("count > 1").isEmpty():
        raise TrainingError("duplicate record or split leakage")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _require_empty(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    if system.exists(folder) and len(system.listStatus(folder)):
        raise TrainingError("the output folder isn't empty")


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, indent=1, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a trained model. One whose labels or thresholds can't be used is an error."""
    system, folder = _folder(spark, f"{path}/{MANIFEST}")
    if not system.exists(folder):
        raise TrainingError("no trained model and manifest")
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).head()[0])
    if manifest.get("labels") != LABELS:
        raise TrainingError("label mapping mismatch")
    if not valid_threshold(manifest.get("decision_thresholds")):
        raise TrainingError("invalid thresholds")
    return manifest


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    manifest = read_manifest(spark, path)
    model = PipelineModel.load(f"{path}/model")
    if model.stages[-1].numClasses != len(LABELS):
        raise TrainingError("label mapping mismatch")
    return model, manifest


def score(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the scores of the labels, in their order. A null text is scored as an empty one."""
    ready = rows.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    scored = model.transform(ready).withColumn("scores", vector_to_array("__probability"))
    return scored.select(*rows.columns, "scores")


def _pipeline(features: int, max_iter: int, regularization: float) -> Pipeline:
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\x20\x09-\x0D]+", gaps=False, toLowercase=True)
    hashed = HashingTF(inputCol="__words", outputCol="__features", numFeatures=features)
    regression = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", family="multinomial", maxIter=max_iter, regParam=regularization)
    return Pipeline(stages=[words, hashed, regression])


def _number(label: str):
    return F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(LABELS) for x in (name, float(i))]), F.col(label))


def _metrics(scored: DataFrame, bars) -> dict:
    plain = {("accuracy" if r["label"] is None else f"recall_{r['label']}"): r["recall"] for r in argmax_metrics(scored).collect()}
    return {**plain, **calibrated_metrics(scored, bars).head().asDict()}


def _calibrated(scored: DataFrame, rate: float, per_class: bool):
    bars = class_thresholds(scored, rate) if per_class else single_threshold(scored, rate)
    # a bar is never under a half; the least double under a score of 0.9 is well above it
    return bars if not isinstance(bars, dict) else {k: max(0.5, v) for k, v in bars.items()}


def _options(caps: dict[str, int], rate: float) -> None:
    if set(caps) != set(SPLITS) or any(n < 1 for n in caps.values()):
        raise TrainingError("limits must be positive")
    if not (math.isfinite(rate) and 0 <= rate <= 0.1):
        raise TrainingError("the allowed rate of false blocks must be 0 to 0.1")


def train(splits: DataFrame, output: str, *, caps: dict[str, int] | None = None, rate: float = 0.01, per_class: bool = False, unmapped: int = 0, features: int = 1 << 16, max_iter: int = 30, regularization: float = 1e-3) -> dict:
    """Train on splits (split, text, label, provenance), write model and manifest under output, and return the manifest.

    caps: the most records of a label that each split gives (2,000 to train, 1,000 to validate, 1,000 to test).
    unmapped: how many rows preparation could not map.
    """
    spark, caps = splits.sparkSession, caps or {"train": 2000, "validation": 1000, "test": 1000}
    _options(caps, rate)
    _require_empty(spark, output)
    # every check and sample reads these rows, which may be costly to make: each is made and digested once
    digested = staged(splits.select("split", "text", "label", "provenance", folded_digest(F.col("text")).alias("digest")), "training-splits")
    try:
        return _train(digested, output, caps, rate, per_class, unmapped, features, max_iter, regularization)
    finally:
        discard(digested)


def _train(digested: DataFrame, output: str, caps: dict[str, int], rate: float, per_class: bool, unmapped: int, features: int, max_iter: int, regularization: float) -> dict:
    """What train does with staged rows: split, text, label, provenance, digest."""
    spark = digested.sparkSession
    check_splits(digested, "digest")
    counted = {(r["split"], r["label"]): r["count"] for r in digested.groupBy("split", "label").count().collect()}
    coverage_gate(unmapped, sum(counted.values()))
    source = {s: {label: counted.get((s, label), 0) for label in LABELS} for s in SPLITS}
    if not all(source["train"].values()):
        raise TrainingError("the training split must have every label")
    if not all(sum(source[s].values()) for s in SPLITS):
        raise TrainingError("no split may be empty")
    part = lambda s: digested.where(F.col("split") == s).drop("provenance")
    picked = {s: bounded_sample(part(s), {}, caps[s]) for s in ("validation", "test")}
    picked["train"] = balanced_sample(part("train"), caps["train"], labels=LABELS)
    chosen = staged(picked["train"].unionByName(picked["validation"]).unionByName(picked["test"]), "training-rows")
    of = lambda s: chosen.where(F.col("split") == s)
    # the same rows in the same partitions give the same model
    rows = of("train").repartition(8, "digest").sortWithinPartitions("digest").withColumn("__text", F.col("text")).withColumn("__label", _number("label"))
    model = _pipeline(features, max_iter, regularization).fit(rows)
    validation, test = (staged(score(model, of(s).select("label", "text")).select("label", "scores"), f"scores-{s}") for s in ("validation", "test"))
    bars = _calibrated(validation, rate, per_class)
    selected = {s: {label: 0 for label in LABELS} for s in SPLITS}
    for r in chosen.groupBy("split", "label").count().collect():
        selected[r["split"]][r["label"]] = r["count"]
    manifest = {
        "seed": SEED, "labels": LABELS, "source_sha256": {s: checksum(part(s)) for s in SPLITS}, "source_counts": source, "selected_counts": selected, "decision_thresholds": bars,
        "max_allowed_false_block_rate": rate, "validation": _metrics(validation, bars), "evaluation": _metrics(test, bars), "features": features,
    }
    model.write().save(f"{output}/model")
    _write_manifest(spark, output, manifest)
    return manifest


def recalibrate(splits: DataFrame, model_path: str, output: str, *, caps: dict[str, int] | None = None, rate: float = 0.01, per_class: bool = True) -> dict:
    """New thresholds for a trained model, from validation records; weights stay. Written beside a copy of the model.

    The training records must be those that the model was trained on: their checksum has to equal the manifest's.
    """
    spark, caps = splits.sparkSession, caps or {"train": 1, "validation": 200, "test": 200}
    _options(caps, rate)
    if output.rstrip("/") == model_path.rstrip("/"):
        raise TrainingError("the output must be another folder")
    _require_empty(spark, output)
    model, manifest = load_model(spark, model_path)
    if checksum(splits.where("split = 'train'")) != manifest["source_sha256"]["train"]:
        raise TrainingError("training data changed; train again before recalibration")
    check_splits(splits)
    digested = splits.select("split", "text", "label", folded_digest(F.col("text")).alias("digest"))
    scored = {}
    for s in ("validation", "test"):
        rows = bounded_sample(digested.where(F.col("split") == s), {}, caps[s])
        scored[s] = staged(score(model, rows.select("label", "text")).select("label", "scores"), f"scores-{s}")
        if scored[s].isEmpty():
            raise TrainingError("no split may be empty")
    bars = _calibrated(scored["validation"], rate, per_class)
    manifest |= {"decision_thresholds": bars, "max_allowed_false_block_rate": rate, "validation": _metrics(scored["validation"], bars), "evaluation": _metrics(scored["test"], bars), "recalibrated": True}
    model.write().save(f"{output}/model")
    _write_manifest(spark, output, manifest)
    return manifest
