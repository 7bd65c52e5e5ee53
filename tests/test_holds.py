"""Runs of evaluations on streams: the processor fed in any batches against the runs read off all evaluations at once."""

import datetime as dt

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.operators.metrics import sustained
from waymark.streaming.holds import ENDED, FIRED, Hold


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), set()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at * 1000


def replay(times, batches, step, hold):
    """Micro-batches with the watermark at each of ``batches``; each gives the evaluations it has passed."""
    processor, handle, out, before = Hold(step, hold, ["k"]), Handle(), [], -1
    processor.init(handle)
    for mark in sorted(batches):
        due = [t for t in times if before < t <= mark]
        if due:
            out += processor.handleInputRows(("a",), iter([pd.DataFrame({"evaluated": due[::-1]})]), Watermark(mark))
        for timer in sorted(t for t in handle.timers if t <= mark * 1000):
            handle.timers.discard(timer)
            out += processor.handleExpiredTimer(("a",), Watermark(mark), None)
        before = mark
    frames = [f for f in out if len(f)]
    return [tuple(None if pd.isna(x) else x for x in r) for f in frames for r in f.itertuples(index=False)], handle.value.held


def runs_of(times, step):
    out = []
    for t in sorted(times):
        if out and out[-1][1] + step == t:
            out[-1][1] = t
        else:
            out.append([t, t])
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 2400), min_size=1, max_size=8), st.integers(0, 5))
def test_any_batches_give_the_runs(places, marks, hold):
    step, hold = 30, hold * 30
    times, end = [30 * p for p in places], max(marks)
    got, state = replay(times, marks, step, hold)
    seen = [t for t in times if t <= end]
    want = []
    for a, z in runs_of(seen, step):
        if z - a >= hold:
            want.append(("a", FIRED, a, a + hold, None))
            if z + step <= end:
                want.append(("a", ENDED, a, a + hold, z))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # A run that has broken leaves no state.
    assert (state is None) == (not seen or max(seen) + step <= end)


def test_the_same_runs_as_on_a_table(spark):
    times = [0, 30, 60, 150, 180, 210, 240, 600]
    at = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), True) for t in times]
    rows = sustained(spark.createDataFrame(at, "evaluated_at timestamp, hit boolean"), F.col("hit"), "evaluated_at", 30, 60)
    begin = dt.datetime(2024, 1, 1)
    table = sorted(((r.started_at - begin).seconds, (r.last_at - begin).seconds) for r in rows.collect())
    got, _ = replay(times, [1000], 30, 60)
    assert table == sorted((r[2], r[4]) for r in got if r[1] == ENDED)
