"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .cotraining import classify
from .decontamination import decontaminate
from .filter_audit import filter_flags, interactions
from .html_text import main_text
from .line_dedup import drop_boilerplate
from .lm import lm_scores
from .mixing import fair_queue
from .near_duplicates import near_duplicates
from .packing import pack
from .quality_rules import quality_rules
from .ranked_search import build_index, search
from .toxicity import toxicity
from .two_fit import pack_two_fit


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, read_table(spark, sf_dir, "labels"), carry=["doc_id"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_boilerplate(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return cut.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars"), F.sha2("clean_text", 256).alias("text_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items, carry=["doc_id"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), carry=["doc_id"])
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), carry=["page_id", "url"])


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed sequence: the documents in it, lengths, and digests of the id matrix row and position resets."""
    rows = pack(read_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("cu_seqlens", lambda x: x.cast("string")), ",")
    return rows.select("block", "sequence", "doc_ids", "offsets", listed.alias("cu_seqlens"), F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify(docs, read_table(spark, sf_dir, "labels"), carry=["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = fair_queue(read_table(spark, sf_dir, "documents"))
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "finish")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scores(docs, carry=["doc_id"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(filter_flags(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_two_fit(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_packing": op7_token_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing": op9_mixing,
    "op10_language_model": op10_language_model,
    "op11_filter_audit": op11_filter_audit,
    "op12_best_two_fit": op12_best_two_fit,
    "op13_ranked_search": op13_ranked_search,
}
