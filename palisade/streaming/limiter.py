"""A rate limiter on a stream: one decision for each request, from state that is dropped once its window has passed.

State is one value for each identity, with the counts of its epoch-aligned windows, kept by Spark's state store and restored
from the query's checkpoint (one of a version that kept a count a window can't be continued). A micro-batch numbers the
requests of an identity on from that count, in order of time and then of `order`, so a stream that brings requests in order decides as operators.gateway.rate_limit does over the whole table. A timer at
the end of an identity's first window removes the counts that the watermark has passed and sets the next.

Defined results: a request that comes later than the watermark gets no row, for its count may be gone; whoever waits for a
decision reads none as a denial. A null identity is one identity of its own. A null time gets no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WindowCounts(StatefulProcessor):
    """Counts of an identity's windows. Rows carry start, the window's first second; they leave with nth."""

    def __init__(self, seconds: int, order: list[str], columns: list[str]):
        self.seconds, self.order, self.columns = seconds, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # every access asks the JVM, so an identity's windows are one value: pairs of start and count, as JSON
        self.counts = handle.getValueState("windows", "pairs string")

    def _held(self) -> dict[int, int]:
        value = self.counts.get()
        return dict(json.loads(value[0])) if value is not None else {}

    def _keep(self, held: dict[int, int]) -> None:
        self.counts.update((json.dumps(list(held.items())),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # only what a micro-batch has of an identity is held together
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        held, nth = self._held(), []
        first = min(held, default=None)
        for start in batch["start"].tolist():
            held[start] = held.get(start, 0) + 1
            nth.append(held[start])
        self._keep(held)
        # one timer at a time, for the first window to end
        if first is None or min(held) < first:
            self.handle.registerTimer((min(held) + self.seconds) * 1000)
        batch["nth"] = pd.Series(nth, index=batch.index, dtype="int64")
        yield batch[[*self.columns, "start", "nth"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self._held()
        left = {start: n for start, n in held.items() if (start + self.seconds) * 1000 > now}
        if left:
            self._keep(left)
            self.handle.registerTimer((min(left) + self.seconds) * 1000)
        elif held:
            self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, *, identity: str = "identity", ts: str = "ts", order: str | None = None, limit: int = 30, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """The streamed requests with window_start, nth (of identity and window) and denied."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # Spark hands rows over as named tuples, so every column gets a plain name meanwhile
    plain = {c: f"c{i}" for i, c in enumerate(requests.columns)}
    timed = requests.where(F.col(ts).isNotNull()).select(*[F.col(f"`{c}`").alias(name) for c, name in plain.items()]).withWatermark(plain[ts], late)
    start = (F.floor(F.unix_timestamp(plain[ts]) / seconds) * seconds).cast("long")
    keyed = timed.withColumn("start", start).withColumn("key", F.coalesce(F.concat(F.lit("i"), F.col(plain[identity]).cast("string")), F.lit("n")))
    schema = T.StructType([*timed.schema.fields, T.StructField("start", T.LongType()), T.StructField("nth", T.LongType())])
    counter = WindowCounts(seconds, [plain[c] for c in (ts, order) if c], list(plain.values()))
    counted = keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=counter, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return counted.select(*[F.col(name).alias(c) for c, name in plain.items()], F.timestamp_seconds("start").alias("window_start"), F.col("nth").cast("int").alias("nth"), (F.col("nth") > limit).alias("denied"))


def write_decisions(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the decisions of what has arrived to a Parquet table, each once, and stop."""
    return decisions.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
