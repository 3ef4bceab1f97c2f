"""Rate limits, audit events and health: the gateway's behaviour over request and event tables, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import keyed_hash, prompt_hash
from ..settings import Settings
from .decide import enabled_policies


def rate_limit(requests: DataFrame, *, identity: str = "identity", ts: str = "ts", order: str | None = None, limit: int = 30, seconds: int = 60, parts: int = 60) -> DataFrame:
    """Adds window_start, nth (of its identity and epoch-aligned window) and denied. Denied requests count as well.

    A window is cut into at most `parts` parts of whole seconds: requests are ranked inside a part, and the sizes of the
    parts before it are added, so one identity's busy window isn't one task's work.
    """
    at = F.unix_timestamp(ts)
    start, width = F.floor(at / seconds) * seconds, max(1, -(-seconds // parts))
    placed = requests.withColumn("window_start", F.timestamp_seconds(start)).withColumn("__part", F.floor((at - start) / width))
    key = [identity, "window_start", "__part"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(identity, "window_start").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(identity).alias("__i"), F.col("window_start").alias("__w"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(ts, *([order] if order else [])))
    ranked = placed.withColumn("__inside", inside)
    same = F.col(identity).eqNullSafe(F.col("__i")) & F.col("window_start").eqNullSafe(F.col("__w")) & F.col("__part").eqNullSafe(F.col("__p"))
    nth = (F.col("__before") + F.col("__inside")).cast("int")
    return ranked.join(before, same).select(*requests.columns, "window_start", nth.alias("nth"), (nth > limit).alias("denied"))


def rate_counts(requests: DataFrame, *, identity: str = "identity", ts: str = "ts", limit: int = 30, seconds: int = 60, late: str | None = None) -> DataFrame:
    """Requests and denials of each identity and window; with `late` it also runs on a stream, with that watermark."""
    source = requests.withWatermark(ts, late) if late else requests
    counted = source.groupBy(identity, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(identity, F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"))


def rate_identity(address: Column, secret: str) -> Column:
    """The keyed hash that stands for an address."""
    return keyed_hash("dlp-rate", secret, F.coalesce(address, F.lit("unknown")))


def user_identity(user: Column, secret: str) -> Column:
    return F.when(user.isNotNull(), keyed_hash("dlp-user", secret, user.cast("string"), "sha256"))


def valid_prompts(requests: DataFrame, prompt: str = "prompt", settings: Settings | None = None) -> DataFrame:
    """Requests whose body and prompt are within limits and not blank; only these are judged and audited."""
    s = settings or Settings()
    p = F.col(prompt)
    return requests.where((F.octet_length(p) <= s.max_body_bytes) & (F.length(p) <= s.max_prompt_chars) & p.rlike(r"[^\s\x1C-\x1F\x85\p{Z}]"))


def audit_events(judged: DataFrame, *, prompt: str = "prompt", user: str | None = None, secret: str = "", created_at: Column | None = None, request_id: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """Audit rows of decisions: hashes, codes and reasons, never text."""
    hashed = user_identity(F.col(user), secret) if user else F.lit(None).cast("string")
    return judged.select(
        (F.expr("uuid()") if request_id is None else request_id).alias("request_id"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        hashed.alias("user_identifier_hash"),
        prompt_hash(F.col(prompt)).alias("prompt_hash"),
        "analysis.*",
        (F.lit(0) if latency_ms is None else latency_ms).cast("int").alias("latency_ms"),
        F.lit(False).alias("forwarded_to_llm"),
    )


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def audit_page(events: DataFrame, number: int = 1, size: int = 50, *, newest: str = "created_at", tie: str = "request_id") -> DataFrame:
    """One page of events, newest first."""
    return events.orderBy(F.desc(newest), F.desc(tie)).offset((number - 1) * size).limit(size)


def health(policies: list, loaders: list | None = None) -> str:
    """ok if there are enabled, valid policies and every configured model loads."""
    try:
        for load in loaders or []:
            load()
    except Exception:  # whatever a model loader raises, the gateway is unavailable
        return "unavailable"
    return "ok" if enabled_policies(policies) else "unavailable"
