"""
Alert rules on streams, with their holding time: the same conditions as on tables, fired as event time passes.

Events become slices, slices become sliding windows, both by watermarked aggregations, so a window is judged once, when the
watermark has passed it. Windows that meet the condition reach a keyed state that extends the run of their key; a timer set
one step after the last of them tells that the run has broken. So state holds one run per key, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from waymark.streaming import alerts

FIRED, ENDED = "firing", "resolved"


class Hold(StatefulProcessor):
    """
    Runs of evaluations one step apart. A run that lasts ``hold`` seconds fires, once; a run that has fired and breaks is
    resolved. Rows of a key may come in any order within a micro-batch.
    """

    def __init__(self, step: int, hold: int, names: Sequence[str]):
        self.step, self.hold, self.names = step, hold, list(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started bigint, last bigint")

    def _row(self, key, state, started, last) -> dict:
        return {**dict(zip(self.names, key)), "state": state, "started": started, "fired": started + self.hold, "last": last}

    def _advance(self, key, times, passed: float) -> Iterator[pd.DataFrame]:
        """Extends the run by ``times``; what the watermark has passed by a step without a row is over."""
        run, out = (tuple(self.run.get()) if self.run.exists() else None), []
        for now in sorted(times):
            if run is not None and now > run[1] + self.step:
                if run[1] - run[0] >= self.hold:
                    out.append(self._row(key, ENDED, *run))
                run = None
            started, last = run or (now, now)
            if now - started >= self.hold and (run is None or last - started < self.hold):
                out.append(self._row(key, FIRED, started, None))
            run = (started, now)
        if run is not None and run[1] + self.step <= passed:
            if run[1] - run[0] >= self.hold:
                out.append(self._row(key, ENDED, *run))
            run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            self.handle.registerTimer((run[1] + self.step) * 1000)
        if out:
            frame = pd.DataFrame(out)
            yield frame.assign(last=frame["last"].astype("Int64"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = {int(t) for frame in rows for t in frame["evaluated"]}
        yield from self._advance(key, times, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, (), timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def windows(events: DataFrame, sums: dict[str, Column], window: int, group: Sequence[str] = (), step: int = alerts.STEP, time: str = "ts") -> DataFrame:
    """Totals of each sliding window of a stream: (group..., at, totals...), ``at`` the last microsecond of the window."""
    if window % step:
        raise ValueError("the window must be a multiple of the step")
    cut = alerts.with_watermark(events, time).groupBy(F.window(time, f"{step} seconds"), *group).agg(*[c.alias(n) for n, c in sums.items()])
    if window > step:
        placed = cut.select(*group, F.window_time("window").alias("_at"), *sums)
        cut = placed.groupBy(F.window("_at", f"{window} seconds", f"{step} seconds"), *group).agg(*[F.sum(n).alias(n) for n in sums])
    return cut.select(*group, F.window_time("window").alias("at"), *sums)


def held(evaluated: DataFrame, condition: Column, hold: int, group: Sequence[str] = (), step: int = alerts.STEP) -> DataFrame:
    """
    Changes of the alerts of a stream of windows: (group..., state, started_at, fired_at, last_at), ``firing`` when a run has
    lasted ``hold`` seconds and ``resolved``, with its last evaluation, when it has broken.
    """
    keys = list(group) or ["all"]
    rows = evaluated.filter(condition)
    rows = rows if group else rows.withColumn("all", F.lit(0))
    rows = rows.select(*keys, "at", (F.unix_micros("at") + 1).alias("evaluated")).withColumn("evaluated", F.expr("evaluated div 1000000"))
    types = dict(rows.dtypes)
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", state string, started bigint, fired bigint, last bigint"
    out = rows.groupBy(*keys).transformWithStateInPandas(Hold(step, hold, keys), ddl, "append", "EventTime")
    return out.select(
        *group, "state", F.timestamp_seconds("started").alias("started_at"), F.timestamp_seconds("fired").alias("fired_at"), F.timestamp_seconds("last").alias("last_at")
    )


def ratio_alert(events: DataFrame, bad: Column, bound: float, window: int, hold: int, group: Sequence[str] = (), step: int = alerts.STEP) -> DataFrame:
    seen = windows(events, {"bad": F.count_if(bad), "total": F.count("*")}, window, group, step)
    return held(seen, F.col("bad") / F.col("total") > bound, hold, group, step)


def rate_alert(events: DataFrame, counted: Column, bound: float, window: int, hold: int, group: Sequence[str] = (), step: int = alerts.STEP) -> DataFrame:
    return held(windows(events, {"n": F.count_if(counted)}, window, group, step), F.col("n") / window > bound, hold, group, step)


def count_alert(events: DataFrame, counted: Column, bound: float, window: int, hold: int, group: Sequence[str]) -> DataFrame:
    return held(windows(events, {"n": F.count_if(counted)}, window, group, window), F.col("n") > bound, hold, group, window)


def quantile_alert(events: DataFrame, value: str, bounds: Sequence[float], q: float, bound: float, window: int, hold: int, group: Sequence[str], step: int = alerts.STEP) -> DataFrame:
    """Slice histograms are summed per window; the quantile is interpolated in the bin that holds it."""
    seen = windows(events, alerts.bin_counts(value, bounds), window, group, step)
    return held(seen, alerts.bin_quantile(bounds, q) > bound, hold, group, step)


def gauge_alert(samples: DataFrame, beyond: Column, hold: int, group: Sequence[str], step: int = alerts.STEP, values: Sequence[str] = ("value",)) -> DataFrame:
    latest = F.max_by(F.struct(*values), F.struct("ts", *values))
    return held(windows(samples, {"v": latest}, step, group, step).select(*group, "at", "v.*"), beyond, hold, group, step)
