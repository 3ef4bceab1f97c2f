"""The training-corpus pipeline: quality, near duplicates, decontamination, mixing, packed token ids.

Each stage works on all that the one before kept; its result is written as Parquet and read again. Every stage but
the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import read_table, staged
from palisade.llm.cotraining import classify
from palisade.llm.decontamination import decontaminate
from palisade.llm.mixing import mixed
from palisade.llm.near_duplicates import without_duplicates
from palisade.llm.packing import pack


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def _judged(docs: DataFrame, uses: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that judge keeps, with the values of docs: columns that it doesn't use have private names meanwhile."""
    own = {c: c if c.lower() in uses else f"__own{i}" for i, c in enumerate(docs.columns)}
    kept = judge(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    return kept.select(*[F.col(f"`{name}`").alias(c) for c, name in own.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    labels = read_table(spark, sf_dir, "labels")
    return _judged(docs, ["doc_id", "text", "lang", "source"], lambda d: classify(d, labels).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near duplicates."""
    return _same(without_duplicates(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than the allowed share of benchmark passages."""
    items = read_table(spark, sf_dir, "benchmark")
    return _judged(docs, ["text"], lambda d: decontaminate(d, items).where("not contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _same(mixed(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of token ids: id matrix rows, cumulative segment lengths and position resets."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", packing),
]

#: Neither a trained classifier nor a tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{number}")
    return docs
