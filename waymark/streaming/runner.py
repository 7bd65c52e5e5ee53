"""Running streams over the files of a folder and keeping what they produce as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.dedup import THRESHOLD, dedup_batch, semantic_dedup
from waymark.session import ROCKSDB_PROVIDER, fresh_path, prepare


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet files of the folder called ``name`` as a stream."""
    schema = prepare(spark).read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """
    Process all that is available in append mode and read the result.

    Output and checkpoint are in the shared folder; the file sink writes each micro-batch once
    even when executors are lost.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    out = fresh_path(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def dedup_stream(stream: DataFrame, table: str, order: str, vector: str = "embedding", bucket: tuple[str, ...] = ("t_id", "scenario_type"),
                 threshold: float = THRESHOLD, block_rows: int = 8_192, parts: int = 64):
    """
    Writer that appends the survivors of each micro-batch to the Parquet table ``table``.

    The table lies in ``parts`` parts by hash of the bucket, so a micro-batch reads only those that its own buckets are
    in. Inside a part a micro-batch owns its partition: one that is run again replaces what it wrote.
    """
    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", F.pmod(F.xxhash64(*bucket), F.lit(parts)).cast("int"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            kept = semantic_dedup(batch, order, vector, bucket, threshold, block_rows).filter("kept").drop("kept")
        else:
            kept = dedup_batch(batch, accepted_of(spark, table, batch, batch_id, placed), order, vector, bucket, threshold, block_rows)
        placed(kept).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part", "_batch").parquet(table)

    return stream.writeStream.foreachBatch(keep)


def accepted_of(spark: SparkSession, table: str, batch: DataFrame, batch_id: int, placed) -> DataFrame:
    """What earlier micro-batches accepted in the parts that ``batch`` has rows in; the others are not read."""
    # at most one number per part
    met = [r["_part"] for r in placed(batch).select("_part").distinct().collect()]
    rows = spark.read.schema(f"{_ddl(batch)}, _part int, _batch int").parquet(table)
    return rows.filter(F.col("_part").isin(met) & (F.col("_batch") < batch_id)).drop("_part", "_batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
