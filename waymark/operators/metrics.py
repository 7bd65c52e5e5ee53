"""Usage, latency and histogram aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bucket boundaries in milliseconds, by what is measured.
BUCKETS = {
    "http": [10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000],
    "provider": [500, 1000, 2500, 5000, 10000, 30000, 60000, 120000],
    "embedding": [50, 100, 250, 500, 1000, 2500, 5000, 15000],
    "task": [1000, 5000, 15000, 30000, 60000, 300000, 600000],
    "vector_search": [5, 10, 25, 50, 100, 250, 500, 1000, 2500],
}
INF = float("inf")


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Rows per (tenant, provider, model, dimension); a null triple marks the tenant's total. One scan."""
    triple = ["embedding_provider", "embedding_model", "dimension"]
    sets = vectors.groupingSets([[F.col("u_id")], [F.col(c) for c in ["u_id", *triple]]], *[F.col(c) for c in ["u_id", *triple]])
    return sets.agg(F.count("*").alias("n"))


def dashboard_stats(rows: DataFrame) -> DataFrame:
    """Intent histogram, number of intents and of distinct API names: (kind, name, n)."""
    intent = F.coalesce("intent_type", "data_category", F.lit("unknown"))
    histogram = rows.groupBy(intent.alias("name")).agg(F.count("*").alias("n"))
    intents = histogram.agg(F.count("*").alias("n"))
    apis = rows.agg(F.count_distinct(F.when(F.col("api_name") != "", F.col("api_name"))).alias("n"))
    none = F.lit(None).cast("string").alias("name")
    return (
        histogram.select(F.lit("intent").alias("kind"), "name", "n")
        .unionByName(intents.select(F.lit("total_intents").alias("kind"), none, "n"))
        .unionByName(apis.select(F.lit("unique_apis").alias("kind"), none, "n"))
    )


def _mean_if_positive(column: str) -> Column:
    # a missing or zero time means the stage did not run
    return F.coalesce(F.avg(F.when(F.col(column) != 0, F.col(column))).cast("bigint"), F.lit(0))


def minute_means() -> list[Column]:
    return [
        F.coalesce(F.avg(F.coalesce("search_latency_ms", F.lit(0.0))).cast("bigint"), F.lit(0)).alias("search_ms"),
        _mean_if_positive("embedding_latency_ms").alias("embedding_ms"), _mean_if_positive("reranker_latency_ms").alias("reranker_ms"),
        F.count("*").alias("n"),
    ]


def telemetry_per_minute(points: DataFrame, last: int | None = None) -> DataFrame:
    """Mean latency of each stage per minute, whole milliseconds; optionally the last minutes only."""
    out = points.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(*minute_means())
    return out.orderBy(F.col("minute").desc()).limit(last) if last else out


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls, failures and latency by (provider, model, status)."""
    return calls.groupBy("provider", "model", "status").agg(
        F.count("*").alias("calls"), F.sum("latency_ms").alias("total_ms"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms")
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens by (provider, model, token_type) from prompt and completion columns."""
    kinds = F.explode(F.array(
        F.struct(F.lit("prompt").alias("token_type"), F.col("prompt_tokens").alias("tokens")),
        F.struct(F.lit("completion").alias("token_type"), F.col("completion_tokens").alias("tokens")),
    ))
    sums = calls.groupBy("provider", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return sums.select("provider", "model", kinds.alias("t")).select("provider", "model", "t.*")


def bucket_le(value: Column, bounds: Sequence[float]) -> Column:
    """Smallest boundary the value does not exceed."""
    out = None
    for b in bounds:
        out = F.when(value <= b, F.lit(float(b))) if out is None else out.when(value <= b, F.lit(float(b)))
    return out.otherwise(F.lit(INF))


def latency_histogram(df: DataFrame, group: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per boundary, +Inf included, every boundary present: (group..., le, n)."""
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), c.alias("n")) for b, c in zip([*bounds, INF], counts)])
    # one aggregated row per group carries all boundaries, so rows are not multiplied before the shuffle
    return df.groupBy(*group).agg(pairs.alias("h")).select(*group, F.explode("h").alias("b")).select(*group, "b.le", "b.n")


def histogram_quantile(histogram: DataFrame, q: float, group: Sequence[str]) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that reaches it; the last bucket gives its lower bound."""
    order = W.partitionBy(*group).orderBy("le")
    everything = W.partitionBy(*group)
    h = histogram.withColumns({
        "_prev_le": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "_prev_n": F.coalesce(F.lag("n").over(order), F.lit(0)),
        "_rank": F.max("n").over(everything) * F.lit(q),
    })
    reached = h.filter((F.col("n") >= F.col("_rank")) & (F.col("n") > 0))
    share = (F.col("_rank") - F.col("_prev_n")) / (F.col("n") - F.col("_prev_n"))
    value = F.when(F.col("le") == INF, F.col("_prev_le")).otherwise(F.col("_prev_le") + (F.col("le") - F.col("_prev_le")) * share)
    first = reached.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return first.select(*group, value.alias("quantile"))


def sustained(windows: DataFrame, condition: Column, at: str, step_seconds: int, for_seconds: int, group: Sequence[str] = ()) -> DataFrame:
    """
    Alerts: a condition that holds in consecutive evaluations for at least the given time.

    ``windows`` has one row per evaluation; a missing evaluation breaks the run. One row per
    run: (group..., started_at, fired_at, last_at). Evaluations are results of windows, a few
    per step, not raw events.
    """
    seconds = F.unix_seconds(at)
    held = windows.filter(condition).withColumn("_t", seconds)
    order = W.partitionBy(*group, "_lane").orderBy("_t")
    # evaluations exactly one step apart share the same value of time minus position
    lane = held.withColumn("_lane", F.pmod(F.col("_t"), F.lit(step_seconds)))
    runs = lane.withColumn("_run", F.col("_t") - F.row_number().over(order) * step_seconds)
    islands = runs.groupBy(*group, "_lane", "_run").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    return islands.filter(F.col("_to") - F.col("_from") >= for_seconds).select(
        *group, F.timestamp_seconds("_from").alias("started_at"), F.timestamp_seconds(F.col("_from") + for_seconds).alias("fired_at"), F.timestamp_seconds("_to").alias("last_at")
    )
