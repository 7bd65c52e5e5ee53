"""
Alert rules over windows, for tables and streams.

Sliding windows are built in two steps: events are reduced to slices as long as the slide,
then each slice is placed in the windows that contain it. Only slice totals are replicated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.metrics import INF, minute_means, sustained

WATERMARK = "10 minutes"
# Bound, window, evaluation step and holding time of each rule, in seconds.
STEP = 30
ERROR_RATIO = dict(bound=0.05, window=300, hold=300)
TASK_FAILURES = dict(bound=0.1, window=600, hold=300)
RATE_LIMITED = dict(bound=50.0, window=300, hold=300)
SLOW_PATHS = dict(bound=5_000.0, q=0.99, window=300, hold=600)
SLOW_PROVIDERS = dict(bound=30_000.0, q=0.95, window=600, hold=600)
LOGIN_FAILURES = dict(bound=20, window=60, hold=60)
POOL_USE = dict(bound=0.9, hold=120)
SERVICE_DOWN = dict(hold=60)
MEMORY_USE = dict(bound=0.85, hold=300)
QUEUE_LENGTH = dict(bound=100, hold=300)
GROUP_INTERVAL = 300


def with_watermark(df: DataFrame, time: str = "ts", delay: str = WATERMARK) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def slices(df: DataFrame, group: Sequence[str], sums: dict[str, Column], step: int = STEP, time: str = "ts") -> DataFrame:
    """Totals per slice of ``step`` seconds: (group..., slice_end, totals...)."""
    cut = with_watermark(df, time).groupBy(F.window(time, f"{step} seconds"), *group).agg(*[c.alias(n) for n, c in sums.items()])
    return cut.select(*group, F.col("window.end").alias("slice_end"), *sums)


def slide(cut: DataFrame, group: Sequence[str], totals: Sequence[str], window: int, step: int = STEP) -> DataFrame:
    """Sliding totals: (group..., evaluated_at, totals...), one evaluation per step that has data in its window."""
    if window % step:
        raise ValueError("the window must be a multiple of the step")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(window // step - 1)))
    placed = cut.select(*group, *totals, "slice_end", shifts.alias("_k"))
    evaluated_at = F.timestamp_seconds(F.unix_seconds("slice_end") + F.col("_k") * step)
    return placed.select(*group, evaluated_at.alias("evaluated_at"), *totals).groupBy(*group, "evaluated_at").agg(*[F.sum(t).alias(t) for t in totals])


def ratio_windows(df: DataFrame, bad: Column, window: int, group: Sequence[str] = (), step: int = STEP) -> DataFrame:
    cut = slices(df, group, {"bad": F.count_if(bad), "total": F.count("*")}, step)
    return slide(cut, group, ["bad", "total"], window, step).withColumn("ratio", F.col("bad") / F.col("total"))


def ratio_alert(df: DataFrame, bad: Column, bound: float, window: int, hold: int, group: Sequence[str] = (), step: int = STEP) -> DataFrame:
    """Share of bad events above the bound for the holding time (server errors, failed tasks)."""
    return sustained(ratio_windows(df, bad, window, group, step), F.col("ratio") > bound, "evaluated_at", step, hold, group)


def rate_alert(df: DataFrame, counted: Column, bound: float, window: int, hold: int, group: Sequence[str] = (), step: int = STEP) -> DataFrame:
    """Events per second above the bound (rate limit violations)."""
    cut = slices(df, group, {"n": F.count_if(counted)}, step)
    rated = slide(cut, group, ["n"], window, step).withColumn("rate", F.col("n") / window)
    return sustained(rated, F.col("rate") > bound, "evaluated_at", step, hold, group)


def count_windows(df: DataFrame, counted: Column, window: int, group: Sequence[str]) -> DataFrame:
    """Tumbling counts per key: (group..., evaluated_at, n)."""
    return slices(df, group, {"n": F.count_if(counted)}, window).withColumnRenamed("slice_end", "evaluated_at")


def count_alert(df: DataFrame, counted: Column, bound: float, window: int, hold: int, group: Sequence[str]) -> DataFrame:
    """More than ``bound`` events of a key per window (login failures per client and minute)."""
    return sustained(count_windows(df, counted, window, group), F.col("n") > bound, "evaluated_at", window, hold, group)


def bin_counts(value: str, bounds: Sequence[float]) -> dict[str, Column]:
    """Cumulative bucket counts, one per boundary."""
    return {f"le_{i}": F.count_if(F.col(value) <= b) for i, b in enumerate(bounds)} | {"le_inf": F.count(value)}


def bin_quantile(bounds: Sequence[float], q: float) -> Column:
    """The quantile that cumulative bucket counts give, interpolated inside the bin that holds it."""
    rank = F.col("le_inf") * q
    out, low, below = None, F.lit(0.0), F.lit(0)
    for name, bound in zip([*[f"le_{i}" for i in range(len(bounds))], "le_inf"], [*bounds, INF]):
        n = F.col(name)
        inside = low if bound == INF else low + (F.lit(float(bound)) - low) * (rank - below) / (n - below)
        hit = (n >= rank) & (n > 0)
        out = F.when(hit, inside) if out is None else out.when(hit, inside)
        low, below = F.lit(float(bound)), n
    return out


def quantile_slices(df: DataFrame, value: str, bounds: Sequence[float], group: Sequence[str], step: int = STEP) -> DataFrame:
    """Cumulative bucket counts per slice, one column per boundary."""
    return slices(df, group, bin_counts(value, bounds), step)


def quantile_windows(cut: DataFrame, bounds: Sequence[float], q: float, window: int, group: Sequence[str], step: int = STEP) -> DataFrame:
    """Histogram quantile of each sliding window: (group..., evaluated_at, quantile)."""
    names = [*[f"le_{i}" for i in range(len(bounds))], "le_inf"]
    return slide(cut, group, names, window, step).select(*group, "evaluated_at", bin_quantile(bounds, q).alias("quantile"))


def quantile_alert(df: DataFrame, value: str, bounds: Sequence[float], q: float, bound: float, window: int, hold: int, group: Sequence[str], step: int = STEP) -> DataFrame:
    """A latency quantile above the bound for the holding time."""
    cut = quantile_slices(df, value, bounds, group, step)
    return sustained(quantile_windows(cut, bounds, q, window, group, step), F.col("quantile") > bound, "evaluated_at", step, hold, group)


def gauge_alert(samples: DataFrame, beyond: Column, hold: int, group: Sequence[str], step: int = STEP, values: Sequence[str] = ("value",)) -> DataFrame:
    """The latest sample of each step beyond its bound for the holding time (pool use, health, memory, queue)."""
    latest = samples.groupBy(F.window("ts", f"{step} seconds"), *group).agg(F.max_by(F.struct(*values), F.struct("ts", *values)).alias("v"))
    return sustained(latest.select(*group, F.col("window.end").alias("evaluated_at"), "v.*"), beyond, "evaluated_at", step, hold, group)


def latency_per_minute(points: DataFrame) -> DataFrame:
    """Mean latency of each stage per minute on a stream or table."""
    grouped = with_watermark(points).groupBy(F.window("ts", "1 minute")).agg(*minute_means())
    return grouped.select(F.col("window.start").alias("minute"), "search_ms", "embedding_ms", "reranker_ms", "n")


def group_alerts(alerts: DataFrame, interval: int = GROUP_INTERVAL) -> DataFrame:
    """
    Notifications: alerts of the same (alertname, cluster, service) within an interval become
    one. A warning is dropped while a critical alert of its name and cluster is in the interval.
    """
    slot = F.window("ts", f"{interval} seconds")["start"].alias("slot")
    rows = alerts.withColumn("slot", slot)
    muted = rows.filter("severity = 'critical'").select("slot", "alertname", "cluster").distinct().withColumn("severity", F.lit("warning"))
    left = rows.join(muted, ["slot", "alertname", "cluster", "severity"], "left_anti")
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "error", 1).otherwise(0)
    return left.groupBy("slot", "alertname", "cluster", "service").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("severity", rank).alias("severity")
    )


def span_durations(starts: DataFrame, ends: DataFrame, max_hours: float | None = None) -> DataFrame:
    """
    Duration in ms of each span from its start (span_id, name, started_at) and finish (span_id,
    finished_at, success). The first finish ends a span; an unfinished one stays, without a duration. On streams
    ``max_hours`` bounds how long a start is remembered: a finished span is given with its finish, an unfinished
    one when the watermark has passed that time. The first finish is there the first to arrive.
    """
    if starts.isStreaming:
        s = starts.withWatermark("started_at", WATERMARK)
        e = ends.withColumnRenamed("span_id", "_end_id").withWatermark("finished_at", WATERMARK).dropDuplicatesWithinWatermark(["_end_id"])
        within = (F.col("span_id") == F.col("_end_id")) & (F.col("finished_at") >= F.col("started_at"))
        within = within & (F.col("finished_at") <= F.col("started_at") + F.expr(f"INTERVAL {int(max_hours or 24)} HOURS"))
        joined = s.join(e, within, "left_outer").drop("_end_id")
    else:
        first = ends.groupBy("span_id").agg(F.min("finished_at").alias("finished_at"), F.min_by("success", "finished_at").alias("success"))
        joined = starts.join(first, "span_id", "left")
    duration = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000
    return joined.withColumn("duration_ms", F.round(duration, 3))


