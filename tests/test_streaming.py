"""The rate limiter on a stream against the batch operator, over restarts, late rows and passed windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators.gateway import rate_limit
from palisade.streaming.limiter import WindowCounts, limit_stream, write_decisions

SCHEMA = "event_id long, ts timestamp, identity string"
T0 = dt.datetime(2026, 1, 1, 0, 0, 0)


def requests(n: int, seed: int, start: dt.datetime = T0):
    r, at, out = random.Random(seed), start, []
    for i in range(n):
        at += dt.timedelta(seconds=r.choice([0, 0, 1, 2, 9]))
        out.append((seed * 100_000 + i, at, r.choice(["hot"] * 6 + ["a", "b", None])))
    return out


def written(spark, rows, folder, number):
    # one file a micro-batch; the name gives their order
    path = folder / f"part-{number:03d}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path))
    (file,) = path.glob("*.parquet")
    (folder / "in").mkdir(exist_ok=True)
    file.rename(folder / "in" / f"{number:03d}.parquet")


def stream(spark, folder):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = write_decisions(limit_stream(source, order="event_id", limit=5), str(folder / "out"), str(folder / "checkpoint"))
    query.awaitTermination()
    return query


@pytest.fixture
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_decides_as_the_batch_and_restarts(small, tmp_path):
    spark, rows = small, requests(300, 1)
    for number in range(3):
        written(spark, rows[60 * number : 60 * (number + 1)], tmp_path, number)
    stream(spark, tmp_path)
    half = spark.read.parquet(str(tmp_path / "out")).count()
    for number in range(3, 5):  # the second run starts from the first one's state
        written(spark, rows[60 * number : 60 * (number + 1)], tmp_path, number)
    stream(spark, tmp_path)
    assert half == 180
    got = {r["event_id"]: (r["window_start"], r["nth"], r["denied"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = rate_limit(spark.createDataFrame(rows, SCHEMA), order="event_id", limit=5)
    assert got == {r["event_id"]: (r["window_start"], r["nth"], r["denied"]) for r in batch.collect()}
    assert any(x[2] for x in got.values())


def test_passed_windows_leave_no_state_and_late_requests_no_row(small, tmp_path):
    spark = small
    written(spark, [*requests(40, 2), (1, None, "a")], tmp_path, 0)
    written(spark, requests(40, 3, T0 + dt.timedelta(hours=1)), tmp_path, 1)
    written(spark, [(7, T0, "hot"), *requests(5, 4, T0 + dt.timedelta(hours=2))], tmp_path, 2)
    written(spark, requests(1, 5, T0 + dt.timedelta(hours=3)), tmp_path, 3)
    query = stream(spark, tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 86 and out.where(F.col("event_id").isin(1, 7)).isEmpty()
    # counts of the hours before are gone; what is left is of the last requests
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] if query.recentProgress else 0
    assert left <= 20


def test_state_calls_do_not_grow_with_windows():
    """An identity with requests in a hundred windows costs one read, one write and one timer a micro-batch."""
    import pandas as pd

    calls = []

    class Handle:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, ms):
            calls.append(ms)

    counter = WindowCounts(60, ["ts"], ["ts"])
    counter.init(Handle())
    batch = pd.DataFrame({"ts": range(200), "start": [60 * (i // 2) for i in range(200)]})
    (out,) = counter.handleInputRows(("k",), iter([batch]), None)
    assert out["nth"].tolist() == [1, 2] * 100 and calls == ["get", "update", 60_000]
    (out,) = counter.handleInputRows(("k",), iter([batch.tail(1)]), None)
    assert out["nth"].tolist() == [3] and calls[3:] == ["get", "update"]
