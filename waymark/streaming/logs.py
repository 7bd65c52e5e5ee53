"""Log enrichment; the same projection serves a table and a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.logs import classify_log
from waymark.functions.scrub import scrub_text
from waymark.functions.text import strip_ansi
from waymark.sources.files import broken_log_rows, keep_log_rows, parse_log_lines

# Loggers whose records go to everyone. A deployment adds its own root logger.
SYSTEM_LOGGERS = [
    "uvicorn", "uvicorn.access", "uvicorn.error", "app.main", "app.core", "app.nlp", "app.services", "app.api", "alembic",
]


def enrich_logs(records: DataFrame, system_loggers: Sequence[str] = SYSTEM_LOGGERS) -> DataFrame:
    """
    Clean, scrub and classify records (ts, logger, message, user_id, ...); ``target`` is "all"
    for system records, else the record's own user. Records with neither are dropped.
    """
    system = F.lit(False)
    for name in system_loggers:
        system = system | F.col("logger").startswith(name)
    routed = records.withColumn("is_system", system).filter(F.col("is_system") | (F.coalesce(F.col("user_id").cast("string"), F.lit("")) != ""))
    clean = routed.withColumn("message", scrub_text(strip_ansi(F.col("message"))))
    return clean.withColumn("_c", classify_log(F.col("message"))).select(
        *clean.columns, F.when(F.col("is_system"), "all").otherwise(F.col("user_id").cast("string")).alias("target"), "_c.*"
    )


def split_log_stream(lines: DataFrame, kept: str, broken: str):
    """
    Writer of a stream of JSON log lines (``value``): readable rows without DEBUG to the Parquet table ``kept``, lines that
    are not JSON to ``broken``, both under one checkpoint.

    A micro-batch owns its partition of either table, so one that is run again replaces what it wrote. Null lines are
    broken ones; a batch without lines writes nothing.
    """
    def divide(batch: DataFrame, batch_id: int) -> None:
        # parsed again for the other table: cheaper than keeping a batch of any size in memory
        rows = parse_log_lines(batch)
        for part, path in ((keep_log_rows(rows), kept), (broken_log_rows(rows), broken)):
            part.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return lines.writeStream.foreachBatch(divide)
