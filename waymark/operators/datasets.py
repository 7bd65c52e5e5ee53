"""Datasets and their embedding lifecycle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# States of an embedding job.
STATES = ["pending", "in_progress", "completed", "failed"]
DEFAULT_PROVIDER = "ollama"


def recent_tasks(tasks: DataFrame, now: dt.datetime, max_age_hours: float = 24, include_completed: bool = True) -> DataFrame:
    """Tasks young enough (or with an unreadable date), optionally without finished ones."""
    created = F.expr("try_to_timestamp(created_at)")
    cutoff = F.lit(now - dt.timedelta(hours=max_age_hours))
    kept = tasks.filter(created.isNull() | (created >= cutoff))
    return kept if include_completed else kept.filter(~F.coalesce("status", F.lit("")).isin("completed", "failed"))


def task_status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def stale_jobs(datasets: DataFrame, now: dt.datetime, older_than_minutes: int = 30) -> DataFrame:
    """Jobs in progress since before the cutoff: their worker died."""
    cutoff = F.lit(now - dt.timedelta(minutes=older_than_minutes))
    return datasets.filter((F.col("embedding_status") == "in_progress") & (F.col("created_at") < cutoff))


def reset_stale(datasets: DataFrame, now: dt.datetime, older_than_minutes: int = 30) -> DataFrame:
    """Stale jobs back to pending, with a message that says how far they were."""
    cutoff = F.lit(now - dt.timedelta(minutes=older_than_minutes))
    stale = F.coalesce((F.col("embedding_status") == "in_progress") & (F.col("created_at") < cutoff), F.lit(False))
    message = F.format_string(
        "Interrupted: reset after server restart (was %d%% done, %d rows embedded)",
        F.coalesce(F.col("embedding_progress").cast("bigint"), F.lit(0)), F.coalesce(F.col("embedded_rows").cast("bigint"), F.lit(0)),
    )
    return datasets.withColumns({
        "embedding_error": F.when(stale, message).otherwise(F.col("embedding_error")),
        "embedding_status": F.when(stale, "pending").otherwise(F.col("embedding_status")),
    })


def advance_embedding_status(datasets: DataFrame, updates: DataFrame) -> DataFrame:
    """
    Apply updates (dataset_id, status, progress, error, embedded_rows), one per dataset at
    most. An unknown state fails the job; progress is held within 0..100; ``completed``
    forces 100 and clears the error.
    """
    valid = F.assert_true(F.col("status").isin(STATES), F.concat(F.lit("invalid embedding_status "), F.coalesce("status", F.lit("null"))))
    changes = updates.select(
        "dataset_id", F.when(valid.isNull(), F.col("status")).alias("_status"), F.col("progress").alias("_progress"),
        F.col("error").alias("_error"), F.col("embedded_rows").alias("_rows"),
    )
    joined = datasets.join(changes, "dataset_id", "left")
    progress = F.greatest(F.lit(0), F.least(F.lit(100), F.col("_progress")))
    done = F.coalesce(F.col("_status") == "completed", F.lit(False))
    return joined.withColumns({
        "embedding_progress": F.when(done, 100).otherwise(F.coalesce(F.when(F.col("_progress").isNotNull(), progress), "embedding_progress")),
        "embedding_error": F.when(done, None).otherwise(F.coalesce("_error", "embedding_error")),
        "embedded_rows": F.coalesce("_rows", "embedded_rows"),
        "embedding_status": F.coalesce("_status", "embedding_status"),
    }).drop("_status", "_progress", "_error", "_rows")


def embedding_progress(rows: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Per dataset: percent done, failed and unroutable rows from row-level flags."""
    sums = rows.groupBy(key).agg(
        F.count("*").alias("total_rows"), F.count_if("embedded").alias("embedded_rows"), F.count_if(F.col("t_id").isNull()).alias("unroutable_rows")
    )
    return sums.withColumns({
        "progress": F.floor(F.col("embedded_rows") * 100 / F.greatest(F.col("total_rows"), F.lit(1))),
        "failed_rows": F.col("total_rows") - F.col("embedded_rows"),
    })


def dataset_stats(datasets: DataFrame) -> DataFrame:
    """Counters of all datasets and one zero-filled count per state."""
    states = [F.count_if(F.col("embedding_status") == s).alias(s) for s in STATES]
    return datasets.agg(
        F.count("*").alias("datasets"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("embedded_rows"), F.lit(0)).alias("embedded_rows"), *states,
    )


def _provider() -> Column:
    return F.coalesce("embedding_provider", F.lit(DEFAULT_PROVIDER))


def embedding_groups(datasets: DataFrame) -> DataFrame:
    """
    Embedded datasets by (tenant, provider, model, dimension): how many, how many rows, newest.

    One row per group whatever its size; ``group_members`` lists the datasets in long form.
    """
    embedded = group_members(datasets)
    return embedded.groupBy("u_id", "provider", "model_id", "dimension").agg(
        F.count("*").alias("n_datasets"), F.sum("rows").alias("n_rows"), F.max("created_at").alias("newest")
    )


def group_members(datasets: DataFrame) -> DataFrame:
    """Completed datasets with their effective triple, one row each."""
    embedded = datasets.filter((F.col("embedding_status") == "completed") & F.col("embedding_model").isNotNull())
    return embedded.select(
        "u_id", _provider().alias("provider"), F.col("embedding_model").alias("model_id"), F.col("embedding_dimension").alias("dimension"),
        "dataset_id", F.coalesce("name", F.lit("Untitled dataset")).alias("name"), F.coalesce("embedded_rows", F.lit(0)).alias("rows"), "created_at",
    )


def embedding_mismatch(datasets: DataFrame, active: DataFrame) -> DataFrame:
    """
    Embedded datasets whose triple is not their tenant's active one, with the two ways out.

    ``active``: (u_id, active_provider, active_model, active_dimension), one row per tenant.
    """
    joined = datasets.filter(F.col("embedding_model").isNotNull()).join(active, "u_id")
    same = (
        (_provider() == F.col("active_provider")) & (F.col("embedding_model") == F.col("active_model"))
        & F.col("embedding_dimension").eqNullSafe(F.col("active_dimension"))
    )
    options = F.array(
        F.struct(F.lit("switch_model").alias("action"), F.concat(F.lit("Search with "), F.col("embedding_model")).alias("label")),
        F.struct(F.lit("reembed").alias("action"), F.concat(F.lit("Re-embed with "), F.col("active_model")).alias("label")),
    )
    return joined.filter(~F.coalesce(same, F.lit(False))).withColumn("provider", _provider()).withColumn("options", options)


def latest_per_key(df: DataFrame, key: str, order: str, tie_break: str) -> DataFrame:
    """Newest row of each key as an aggregate, so a hot key is pre-reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    # on equal times the smaller id is kept
    best = df.groupBy(key).agg(F.max_by(row, F.struct(F.col(order), -F.col(tie_break))).alias("r"))
    return best.select("r.*")


def preferred_connection(connections: DataFrame) -> DataFrame:
    """One active connection per (user, provider): the default first, then the latest update, nulls last."""
    order = W.partitionBy("u_id", "provider").orderBy(F.col("is_default").desc(), F.col("updated_at").desc_nulls_last(), F.col("config_id"))
    return connections.filter("is_active = 1").withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
