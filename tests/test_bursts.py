"""Failure bursts over segments of any size against a walk through the outcomes in order."""

import datetime as dt
import random

import pytest

from waymark.streaming import breaker

BEGIN = dt.datetime(2024, 1, 1)


def walked(rows):
    out, bursts, state = [], [], {}
    for name, event, at, success in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last, n, burst = state.get(name, (None, 0, None))
        if success:
            state[name] = (None, 0, None)
            continue
        if last is None or (at - last).total_seconds() >= breaker.FAILURE_WINDOW:
            n, burst = 0, [name, at, at, 0]
            bursts.append(burst)
        burst[2], burst[3] = at, n + 1
        out.append((name, event, at, n + 1))
        state[name] = (at, n + 1, burst)
    return sorted(out), sorted(tuple(b) for b in bursts if b[3] >= breaker.THRESHOLD)


@pytest.mark.parametrize("rows_each, failing", [(10_000, 0.6), (7, 0.6), (3, 0.97), (5, 1.0), (1, 0.9)])
def test_segments(spark, rows_each, failing):
    draw = random.Random(rows_each)
    rows, at = [], 0.0
    for event in range(120):
        # One name has most of the outcomes; pauses past the window break runs.
        at += draw.choice([0, 1, 5, 20, 61] if event % 10 else [100])
        rows.append((draw.choice([0, 0, 0, 0, 1, 2]), event, BEGIN + dt.timedelta(seconds=at), draw.random() >= failing))
    df = spark.createDataFrame(rows, "name bigint, event_id bigint, ts timestamp, success boolean")
    counts, bursts = walked(rows)
    assert sorted(tuple(r) for r in breaker.failure_counts(df, rows_each).collect()) == counts
    assert sorted(tuple(r) for r in breaker.failure_bursts(df, rows_each=rows_each).collect()) == bursts


def test_none(spark):
    none = spark.createDataFrame([], "name bigint, event_id bigint, ts timestamp, success boolean")
    assert breaker.failure_counts(none).count() == breaker.failure_bursts(none).count() == 0
