"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from palisade.plans.queries import QUERIES
from palisade.session import local_session

HEADLINE = [
    "normalize_digest", "policy_hits", "decisions", "chunk_windows", "cross_turn_text", "raw_row_adapter", "dedupe_records",
    "group_propagation", "topk_per_label", "class_candidates", "calibrated_metrics", "rate_limit", "audit_page", "class_thresholds",
    "masked_documents", "policy_cues",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = {n: QUERIES[n] for n in HEADLINE}
    try:
        from palisade.llm.queries import QUERIES as more

        import corpus_pipeline

        queries |= {**more, "pipeline": corpus_pipeline.run}
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "palisade.llm"):
            raise
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name, query in queries.items():
        took = []
        while not took or len(took) < 3 and took[0] < 8:  # short runs vary most: the median of three
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(median(took), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
