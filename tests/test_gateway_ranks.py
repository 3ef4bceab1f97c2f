"""The rate limiter's ranks against a plain count."""

import datetime as dt
import random
from collections import Counter

from palisade.operators.gateway import rate_limit


def test_ranks_in_parts_of_a_window(spark):
    r, t0, rows = random.Random(5), dt.datetime(2026, 3, 1), []
    for i in range(600):
        at = t0 + dt.timedelta(seconds=r.randint(0, 250), milliseconds=r.choice([0, 0, 250, 999]))
        rows.append((i, at, r.choice(["hot"] * 5 + ["a", None])))
    rows.append((600, None, "a"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, identity string")
    seen, want = Counter(), {}
    for i, at, who in sorted(rows, key=lambda x: (x[1] or t0 - dt.timedelta(1), x[0])):
        window = None if at is None else (at - t0).seconds // 60
        seen[who, window] += 1
        want[i] = seen[who, window]
    for parts in (1, 7, 60, 1000):
        got = {x["event_id"]: (x["nth"], x["denied"]) for x in rate_limit(df, order="event_id", limit=5, parts=parts).collect()}
        assert got == {i: (n, n > 5) for i, n in want.items()}
