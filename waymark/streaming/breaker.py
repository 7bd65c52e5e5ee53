"""
Failure bursts and circuit-breaker history from ordered call outcomes.

Input: (name, event_id, ts, success). The same small state machines serve tables, where each
dependency's outcomes are read in order as a stream of Arrow batches, and Structured Streaming,
where the state lives in the state store between batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from waymark.session import checkpointed

# Failures that trip, seconds blocked, seconds a failure counts, life of the mark.
THRESHOLD, RECOVERY, FAILURE_WINDOW = 5, 30, 60
MARK_LIFE, PROBE_LIFE = RECOVERY * 3, RECOVERY // 2
MICROS = 1_000_000
# Outcomes of one segment of the scan over ordered outcomes.
SEGMENT_ROWS = 1_000_000

BURST_DDL = "name bigint, event_id bigint, ts timestamp, failures bigint"
TIMELINE_DDL = "name bigint, event_id bigint, ts timestamp, state string, admitted boolean, failures bigint, tripped boolean"

TIMELINE_ARROW = pa.schema([
    ("name", pa.int64()), ("event_id", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("state", pa.string()),
    ("admitted", pa.bool_()), ("failures", pa.int64()), ("tripped", pa.bool_()),
])


def _count_failure(state: dict, now: int) -> int:
    failures = state.get("failures", 0) + 1 if now < state.get("failures_until", 0) else 1
    state.update(failures=failures, failures_until=now + FAILURE_WINDOW * MICROS)
    return failures


def count_step(state: dict, now: int, success: bool) -> tuple | None:
    """Running number of failures; each one refreshes the window, a success resets it."""
    if success:
        state.clear()
        return None
    return (_count_failure(state, now),)


def breaker_step(state: dict, now: int, success: bool) -> tuple:
    """(state met by the call, admitted, failures after it, tripped by it)."""
    if now < state.get("open_until", 0):
        return ("open", False, state.get("failures", 0), False)
    met = "closed"
    if now < state.get("mark_until", 0):
        if now < state.get("probe_until", 0):
            # another probe is out
            return ("open", False, state.get("failures", 0), False)
        met = "half_open"
        state["probe_until"] = now + PROBE_LIFE * MICROS
    if success:
        state.clear()
        return (met, True, 0, False)
    failures = _count_failure(state, now)
    tripped = failures >= THRESHOLD
    if tripped:
        state.update(open_until=now + RECOVERY * MICROS, mark_until=now + MARK_LIFE * MICROS)
        state.pop("probe_until", None)
    return (met, True, failures, tripped)


def _frame(name, rows: list, ddl: str) -> pd.DataFrame:
    names = [part.split()[0] for part in ddl.split(", ")]
    frame = pd.DataFrame(rows, columns=names[1:])
    frame.insert(0, names[0], name)
    frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
    return frame


# --- tables ------------------------------------------------------------------------------------

def thin_outcomes(outcomes: DataFrame) -> DataFrame:
    """
    Outcomes without the successes that cannot matter.

    Time is cut into slots of the blocking time. In a slot without failures, after a slot
    without failures, the circuit cannot be open, so the first success resets it and the others
    change nothing. The test runs per (name, slot), so a busy dependency spreads over tasks.
    """
    slotted = outcomes.withColumn("_slot", F.floor(F.unix_micros("ts") / (RECOVERY * MICROS)))
    failing = slotted.filter(~F.col("success")).select("name", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)).alias("_slot")).distinct()
    near = slotted.join(failing, ["name", "_slot"], "left_semi").drop("_slot")
    calm = slotted.join(failing, ["name", "_slot"], "left_anti")
    row = F.struct(*[F.col(c) for c in outcomes.columns])
    first = calm.groupBy("name", "_slot").agg(F.min_by(row, F.struct("ts", "event_id")).alias("r")).select("r.*")
    return near.unionByName(first)


def _segments(outcomes: DataFrame, rows_each: int) -> DataFrame:
    """
    Outcomes in order, cut into ranges of (name, ts, event_id) of about ``rows_each`` rows whatever the names: columns
    ``_part``, ``_run`` (0 for what may go on from the segment before) and ``_n``, the number in the run inside the segment.
    """
    order = ["name", "ts", "event_id"]
    thin = thin_outcomes(outcomes)
    parts = max(1, -(-thin.count() // rows_each))
    dealt = thin.select(*order, "success").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    segment = W.partitionBy("name", "_part").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(segment)) >= FAILURE_WINDOW * MICROS
    # A segment's first outcome starts a run only if it is a success; a failure there may go on.
    starts = F.col("success") | F.coalesce(gap | F.lag("success").over(segment), F.lit(False))
    marked = cut.withColumn("_run", F.sum(starts.cast("int")).over(segment))
    inside = W.partitionBy("name", "_part", "_run").orderBy("ts", "event_id")
    return marked.withColumn("_n", F.sum((~F.col("success")).cast("bigint")).over(inside))


def _numbered(outcomes: DataFrame, rows_each: int) -> DataFrame:
    """
    Failures with ``failures``, their number in the burst, and ``_burst``, which names the burst within its name.

    One summary a segment says whether it opens a run, how long its last run is and whether its first outcome goes on
    from the segment before; sums over the summaries, as many as segments, carry runs across.
    """
    marked = checkpointed(_segments(outcomes, rows_each))
    first, last = F.struct("ts", "event_id"), F.struct("_run", "ts", "event_id")
    parts = marked.groupBy("name", "_part").agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.min_by("success", first).alias("_opens"), F.max_by("success", first).alias("_closes"),
        F.max("_run").alias("_last"), F.max_by("_n", last).alias("_tail"),
    )
    by_name = W.partitionBy("name").orderBy("_part")
    near = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(by_name)) < FAILURE_WINDOW * MICROS
    linked = parts.withColumn("_linked", F.coalesce(near & ~F.col("_opens") & ~F.lag("_closes").over(by_name), F.lit(False)))
    chained = linked.withColumn("_chain", F.sum(((F.col("_last") > 0) | ~F.col("_linked")).cast("int")).over(by_name))
    so_far = chained.withColumn("_held", F.sum("_tail").over(W.partitionBy("name", "_chain").orderBy("_part")))
    carried = so_far.select(
        "name", "_part", "_last", "_linked", "_chain",
        F.when(F.col("_linked"), F.lag("_held").over(by_name)).otherwise(0).alias("_carry"), F.lag("_chain").over(by_name).alias("_before"),
    )
    # A run at a segment's edge goes by its chain, one inside by its segment and number.
    goes_on = (F.col("_run") == 0) & F.col("_linked")
    chain = F.when(goes_on, F.col("_before")).when(F.col("_run") == F.col("_last"), F.col("_chain"))
    inner = F.when(chain.isNull(), F.struct("_part", "_run"))
    joined = marked.filter(~F.col("success")).join(carried, ["name", "_part"])
    return joined.select(
        "name", "event_id", "ts", (F.col("_n") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)).alias("failures"), F.struct(chain.alias("chain"), inner.alias("inner")).alias("_burst")
    )


def failure_counts(outcomes: DataFrame, rows_each: int = SEGMENT_ROWS) -> DataFrame:
    """Each failure with its number in the burst: a gap over the window or a success starts anew."""
    return _numbered(outcomes, rows_each).select("name", "event_id", "ts", "failures")


def failure_bursts(outcomes: DataFrame, n: int = THRESHOLD, rows_each: int = SEGMENT_ROWS) -> DataFrame:
    """Bursts that reach n failures: (name, started_at, last_at, failures)."""
    grouped = _numbered(outcomes, rows_each).groupBy("name", "_burst").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.max("failures").alias("failures"))
    return grouped.filter(F.col("failures") >= n).drop("_burst")


def breaker_timeline(outcomes: DataFrame, thin: bool = True) -> DataFrame:
    """
    What every call met. Outcomes arrive sorted and pass through in batches, so memory does not
    grow with the log of a dependency. ``thin`` leaves out successes that change nothing.
    """
    rows = thin_outcomes(outcomes) if thin else outcomes
    ordered = rows.select("name", "event_id", "ts", "success").repartition("name").sortWithinPartitions("name", "ts", "event_id")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        last = None
        for batch in batches:
            frame = batch.to_pandas()
            micros = frame["ts"].dt.tz_localize(None).astype("datetime64[us]").astype("int64")
            out = []
            for event, now, success in zip(frame["event_id"], micros, frame["success"]):
                if last is not None and now < last:
                    raise ValueError("outcomes of a dependency must arrive in time order")
                last = now
                out.append((event, now, *breaker_step(state, int(now), bool(success))))
            result = _frame(frame["name"].iloc[0], out, TIMELINE_DDL)
            result["ts"] = result["ts"].dt.tz_localize("UTC")
            yield pa.RecordBatch.from_pandas(result, schema=TIMELINE_ARROW, preserve_index=False)

    return ordered.groupBy("name").applyInArrow(replay, TIMELINE_DDL)


# --- streams -----------------------------------------------------------------------------------

class _Replay(StatefulProcessor):
    """Keeps one machine's state per dependency; rows of a micro-batch are taken in time order."""

    step = None
    ddl = ""

    def init(self, handle) -> None:
        self.memory = handle.getValueState("machine", "memory string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one key's rows of one micro-batch; the trigger bounds them
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        micros = frame["ts"].astype("datetime64[us]").astype("int64")
        out = []
        for event, now, success in zip(frame["event_id"], micros, frame["success"]):
            result = type(self).step(state, int(now), bool(success))
            if result is not None:
                out.append((event, now, *result))
        self.memory.update((json.dumps(state),))
        yield _frame(key[0], out, self.ddl)

    def close(self) -> None:
        pass


class CountFailures(_Replay):
    step = staticmethod(count_step)
    ddl = BURST_DDL


class Breaker(_Replay):
    step = staticmethod(breaker_step)
    ddl = TIMELINE_DDL


def _stateful(outcomes: DataFrame, processor: _Replay) -> DataFrame:
    rows = outcomes.select("name", "event_id", "ts", "success")
    return rows.groupBy("name").transformWithStateInPandas(processor, processor.ddl, "append", "None")


def failure_counts_stream(outcomes: DataFrame) -> DataFrame:
    return _stateful(outcomes, CountFailures())


def breaker_timeline_stream(outcomes: DataFrame) -> DataFrame:
    return _stateful(outcomes, Breaker())
