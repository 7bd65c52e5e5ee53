"""The action log: normalisation, filtering and statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UUID_PATTERN = r"(?i)^(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def naive_utc(value: dt.datetime | None) -> dt.datetime | None:
    if value is None or value.tzinfo is None:
        return value
    return value.astimezone(dt.timezone.utc)


def audit_filter(
    logs: DataFrame, action: str | None = None, resource_type: str | None = None,
    start: dt.datetime | None = None, end: dt.datetime | None = None, success: bool | None = None,
) -> DataFrame:
    """All given conditions hold; both time bounds are inclusive."""
    for column, value in (("action", action), ("resource_type", resource_type), ("success", None if success is None else int(success))):
        if value is not None:
            logs = logs.filter(F.col(column) == value)
    if start is not None:
        logs = logs.filter(F.col("created_at") >= F.lit(naive_utc(start)))
    if end is not None:
        logs = logs.filter(F.col("created_at") <= F.lit(naive_utc(end)))
    return logs


def normalise_audit(logs: DataFrame) -> DataFrame:
    """Stored shape of an action: id kept only when it is a UUID, detail as metadata, e-mail never kept."""
    is_uuid = F.coalesce(F.col("resource_id").rlike(UUID_PATTERN), F.lit(False))
    given = F.map_filter(
        F.create_map(
            F.lit("detail"), F.when(F.col("detail") != "", F.col("detail")),
            F.lit("resource_id_str"), F.when((F.col("resource_id") != "") & ~is_uuid, F.col("resource_id")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return logs.withColumns({
        "metadata": F.when(F.size(given) > 0, given),
        "resource_id": F.when(is_uuid, F.col("resource_id")),
        "resource_type": F.coalesce(F.when(F.col("resource_type") != "", F.col("resource_type")), F.lit("system")),
        "error_message": F.when(F.col("success") == 0, F.col("detail")),
    }).drop("detail", "user_email")


def audit_stats(logs: DataFrame, start: dt.datetime | None = None) -> DataFrame:
    """Totals, per action and per resource in one scan: (kind, name, n, n_success, n_failed)."""
    rows = audit_filter(logs, start=start)
    sets = rows.groupingSets([[], [F.col("action")], [F.col("resource_type")]], F.col("action"), F.col("resource_type"))
    counted = sets.agg(
        F.count("*").alias("n"), F.count_if(F.col("success") == 1).alias("n_success"), F.count_if(F.col("success") != 1).alias("n_failed"),
        F.grouping_id().alias("g"),
    )
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "action").otherwise("resource")
    name = F.when(F.col("g") == 1, F.col("action")).when(F.col("g") == 2, F.col("resource_type"))
    return counted.select(kind.alias("kind"), name.alias("name"), "n", "n_success", "n_failed")


def recent_k(logs: DataFrame, k: int = 10, by: str = "user_id") -> DataFrame:
    """The k latest actions of each user; the group limit prunes before the shuffle."""
    order = W.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("log_id").desc())
    return logs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
