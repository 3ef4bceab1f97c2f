"""Optional model stages for texts that no rule blocks. Models are callables; none is bundled.

A stage is made on each worker by its loader. Whatever goes wrong in it makes the decision fail closed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import isfinite
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policies import LABELS, Policy


def block_label(scores: dict[str, float], threshold: float | dict[str, float]) -> str | None:
    """The winning blocked label if it beats the allowed score and its bar."""
    if set(scores) != set(LABELS) or any(isinstance(v, bool) or not isinstance(v, (int, float)) or not isfinite(v) or not 0 <= v <= 1 for v in scores.values()):
        raise ValueError("invalid classifier output")
    best = max(scores[x] for x in LABELS[1:])
    winner = next(x for x in LABELS[1:] if scores[x] == best)
    bar = threshold[winner] if isinstance(threshold, dict) else threshold
    return winner if best > scores["allowed"] and best > bar else None


def valid_threshold(threshold: float | dict[str, float]) -> bool:
    values = threshold.values() if isinstance(threshold, dict) else [threshold]
    named = not isinstance(threshold, dict) or set(threshold) == set(LABELS[1:])
    return named and all(isinstance(v, (int, float)) and not isinstance(v, bool) and isfinite(v) and 0.5 <= v <= 1 for v in values)


def windows(text: str, width: int, stride: int) -> list[str]:
    return [text[i : i + width] for i in range(0, len(text), stride)]


@dataclass
class Stage:
    """load() gives a function from a text to the categories that it adds. strict: adding a category without an
    enabled policy makes the decision unavailable."""

    load: Callable[[], Callable[[str], set[str]]]
    strict: bool = False

    def extend(self, judged: DataFrame, text: str, policies: list[Policy]) -> DataFrame:
        codes = {c: sorted(p.code for p in policies if p.category == c) for c in {p.category for p in policies}}
        load, strict = self.load, self.strict
        made: list = []  # the model, once in a task

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def more(texts: pd.Series) -> pd.Series:
            if not made:
                try:
                    made.append(load())
                except Exception:  # a model that doesn't load fails closed
                    made.append(None)
            stage = made[0]

            def one(value):
                if value is None:
                    return []
                try:
                    found = stage(value)
                    added = sorted({code for c in found for code in codes.get(c, [])})
                    return None if strict and any(not codes.get(c) for c in found) else added
                except Exception:  # a model that breaks fails closed
                    return None

            return texts.map(one)

        # rows that a rule blocked or an earlier stage failed on aren't sent
        first = F.col("__clear") if "__clear" in judged.columns else (F.size("__codes") == 0) & ~F.col("__failed")
        marked = judged.withColumn("__clear", first)
        scored = marked.withColumn("__more", more(F.when(F.col("__clear"), F.col(text))))
        failed = F.col("__failed") | (F.col("__clear") & F.col("__more").isNull())
        codes_ = F.sort_array(F.array_union("__codes", F.coalesce("__more", F.array().cast("array<string>"))))
        return scored.withColumn("__codes", codes_).withColumn("__failed", failed).drop("__more")


def classifier(load: Callable, threshold: float | dict[str, float], max_length: int) -> Stage:
    """load() gives a function from a text to the scores of the labels. Long texts are judged by half-overlapping windows."""

    def build():
        if not valid_threshold(threshold) or not 16 <= max_length <= 512:
            raise ValueError("invalid model manifest")
        model, width = load(), min(800, max(64, 2 * max_length))

        def stage(text: str) -> set[str]:
            found = {block_label(model(w), threshold) for w in windows(text, width, width // 2)}
            return {x.removeprefix("blocked_") for x in found if x}

        return stage

    return Stage(build)


def local_folder(path: str) -> Path:
    """A folder on this machine, named by its whole path; models come from nowhere else."""
    folder = Path(path)
    if not folder.is_absolute() or not folder.is_dir():
        raise ValueError("no local model")
    return folder


def local_classifier(path: str, load: Callable[[Path], tuple[set[str], Callable]]) -> Stage:
    """The classifier in a folder that every worker has, as its manifest says: labels, thresholds and the longest input.

    load(folder) gives the labels of the model and the function from a text to their scores.
    """

    def build():
        folder = local_folder(path)
        labels, model = load(folder)
        if set(labels) != set(LABELS):
            raise ValueError("invalid labels")
        manifest = json.loads((folder / "training_manifest.json").read_text(encoding="utf-8"))
        threshold, longest = manifest.get("decision_thresholds") or manifest.get("decision_threshold"), manifest["max_length"]
        if not isinstance(longest, int) or isinstance(longest, bool):
            raise ValueError("invalid model length")
        return classifier(lambda: model, threshold, longest).load()

    return Stage(build)


# The guards that may be used, and the labels that each must have.
GUARD_LABELS = {"protectai": {"SAFE", "INJECTION"}, "deepset": {"LEGIT", "INJECTION"}}
_ATTACK = "INJECTION"


def listed_guard(name: str, path: str, load: Callable[[Path], tuple[list[str], int, Callable, Callable]], threshold: float = 0.9) -> Stage:
    """A guard of the list, from a folder that every worker has.

    load(folder) gives the labels by number, how many special tokens an input gets, and the functions from a text to token
    ids and from ids to the scores of the labels. A guard that isn't listed, has other labels, a threshold out of
    range or scores that are no probabilities makes decisions unavailable.
    """

    def build():
        if name not in GUARD_LABELS:
            raise ValueError("guard isn't listed")
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not isfinite(threshold) or not 0.5 <= threshold <= 1:
            raise ValueError("invalid threshold")
        labels, specials, tokenise, scores = load(local_folder(path))
        if set(labels) != GUARD_LABELS[name]:
            raise ValueError("other labels than listed")
        width = 512 - specials
        if width < 32:
            raise ValueError("no room for tokens")
        attack = labels.index(_ATTACK)

        def score(ids) -> float:
            values = scores(ids)
            if len(values) != len(labels) or any(not isfinite(v) or not 0 <= v <= 1 for v in values):
                raise ValueError("invalid scores")
            return values[attack]

        return guard(lambda: (tokenise, score), threshold, width).load()

    return Stage(build, strict=True)


def guard(load: Callable, threshold: float = 0.9, width: int = 512, overlap: int = 64) -> Stage:
    """load() gives (tokenise, score): token ids of a text, and an attack score of some ids. Fires at the threshold."""

    def build():
        tokenise, score = load()

        def stage(text: str) -> set[str]:
            ids = tokenise(text)
            return {"prompt_injection"} if any(score(ids[i : i + width]) >= threshold for i in range(0, max(len(ids), 1), width - overlap)) else set()

        return stage

    return Stage(build, strict=True)


def entities(load: Callable) -> Stage:
    """load() gives a function from a text to the personal-data entities in it; any of them adds the pii policies."""

    def build():
        find = load()
        return lambda text: {"pii"} if find(text) else set()

    return Stage(build)
