"""The vector table: Parquet partitioned by (embedding_provider, embedding_model, dimension, dataset_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = ["embedding_provider", "embedding_model", "dimension"]
PARTITIONS = TRIPLE + ["dataset_id"]


def stamped(df: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """Rows ready to append: width checked on every row, defaults filled, triple stamped."""
    width_ok = F.assert_true(
        F.size("embedding") == dimension,
        F.concat(F.lit(f"embedding dimension mismatch: expected {dimension}, got "), F.size("embedding").cast("string")),
    )
    defaults = {"method": "POST", "scenario_type": "valid"}
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return (
        df.withColumn("embedding", F.when(width_ok.isNull(), F.col("embedding")))
        .withColumn("embedding_provider", F.lit(provider))
        .withColumn("embedding_model", F.lit(model))
        .withColumn("dimension", F.lit(dimension))
    )


def _by_partition(df: DataFrame) -> DataFrame:
    """Rows of a dataset together, so that a task writes few files; Spark splits a dataset too large for one task."""
    return df.hint("rebalance", "dataset_id")


def append_vectors(df: DataFrame, path: str, provider: str, model: str, dimension: int) -> None:
    """Append; a single row of the wrong width fails the whole write."""
    _by_partition(stamped(df, provider, model, dimension)).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def replace_dataset_vectors(df: DataFrame, path: str, provider: str, model: str, dimension: int) -> None:
    """
    Re-embed datasets: the partitions of the datasets in ``df`` are replaced, others stay.

    Dynamic partition overwrite swaps only the partitions written, so running it twice
    gives the same table.
    """
    (
        _by_partition(stamped(df, provider, model, dimension))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete_vectors(vectors: DataFrame, tenant, keys: DataFrame, by: str = "dataset_id") -> DataFrame:
    """What remains of ``vectors`` after deleting the tenant's rows whose ``by`` is among ``keys``."""
    doomed = keys.select(by).distinct().withColumn("u_id", F.lit(tenant))
    return vectors.join(doomed, ["u_id", by], "left_anti")


def deleted_counts(tables: dict[str, DataFrame], tenant, keys: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Rows a cascading delete removes from each table: (table_name, deleted)."""
    doomed = keys.select(by).distinct().withColumn("u_id", F.lit(tenant))
    parts = [
        df.join(doomed, ["u_id", by], "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def measured_dimension(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Width of each dataset's vectors from the vectors themselves; null when they disagree."""
    widths = vectors.groupBy(*(keys or ["dataset_id"])).agg(
        F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")
    )
    return widths.withColumn("measured", F.when(F.col("low") == F.col("high"), F.col("low").cast("bigint"))).drop("low", "high")


def retag_dimension(datasets: DataFrame, measured: DataFrame) -> DataFrame:
    """Record the measured width on each dataset; ``retagged`` marks those that changed."""
    joined = datasets.join(measured, "dataset_id", "left")
    changed = F.col("measured").isNotNull() & ~F.col("embedding_dimension").eqNullSafe(F.col("measured"))
    return (
        joined.withColumn("retagged", changed)
        .withColumn("embedding_dimension", F.coalesce("measured", "embedding_dimension").cast("bigint"))
        .drop("measured")
    )
