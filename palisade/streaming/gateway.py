"""The gateway as Structured Streaming: decisions to an audit table, and rate counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.decide import analyze
from ..operators.gateway import append_audit, audit_events, rate_counts, valid_prompts


def audit_stream(requests: DataFrame, path: str, checkpoint: str, *, prompt: str = "prompt", **options) -> StreamingQuery:
    """Judge a stream of requests and append one audit row for each valid one. Nothing is forwarded before its row is written."""

    def batch(rows: DataFrame, epoch: int) -> None:
        append_audit(audit_events(analyze(valid_prompts(rows, prompt), prompt, **options), prompt=prompt), path)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_stream(requests: DataFrame, path: str, checkpoint: str, *, limit: int = 30, seconds: int = 60, late: str = "2 minutes") -> StreamingQuery:
    """Requests and denials of each identity and window, written once the watermark has passed the window."""
    counts = rate_counts(requests, limit=limit, seconds=seconds, late=late)
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
