"""Row scoping: tenant, equality filters, substring search, paging, point lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant_scope(df: DataFrame, tenant, column: str = "u_id") -> DataFrame:
    """The tenant's rows. An unset tenant matches nothing."""
    return df.filter(F.col(column) == F.lit(tenant))


def equality_filters(df: DataFrame, **wanted) -> DataFrame:
    """All equalities must hold; ``None`` leaves a column unfiltered."""
    given = [(k, v) for k, v in wanted.items() if v is not None]
    return reduce(lambda acc, kv: acc.filter(F.col(kv[0]) == F.lit(kv[1])), given, df)


def name_contains(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Case-insensitive substring; % and _ are ordinary characters."""
    return df if text is None else df.filter(F.lower(F.col(column)).contains(text.lower()))


def with_total(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Attach the row count of ``counted`` as a scalar subquery (no window over the whole table)."""
    total = counted.agg(F.count("*").alias("total")).scalar()
    return rows.withColumn("total", total)


def page(df: DataFrame, order: str, offset: int = 0, limit: int = 50, tie_break: str | None = None) -> DataFrame:
    """Newest first, ties by id, with the total under the same filters."""
    keys = [F.col(order).desc_nulls_last()] + ([F.col(tie_break).asc()] if tie_break else [])
    return with_total(df.orderBy(*keys).offset(offset).limit(limit), df)


def preview(df: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset..offset+limit in file order, with total and has_more."""
    rows = with_total(df.orderBy(*order).offset(offset).limit(limit), df)
    return rows.withColumn("has_more", F.col("total") > offset + limit)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def rows_by_scenario(df: DataFrame, dataset, scenario: str | None = None) -> DataFrame:
    return equality_filters(df, dataset_id=dataset, scenario_type=scenario)


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row, one flag."""
    return df.agg((F.count_if(condition) > 0).alias("found"))
