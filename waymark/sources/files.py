"""Utterance files, case files and JSON log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts a CSV reader takes for a missing value.
MISSING_CELLS = [
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Columns of a case file, in order.
CASE_COLUMNS = [
    "query", "api", "endpoint", "method", "request", "expected_response", "scenario_type", "test_category",
    "intent_type", "confidence_score", "notes",
]
LOG_SCHEMA = T.StructType([
    T.StructField(name, T.StringType())
    for name in (
        "timestamp", "severity", "message", "request_id", "trace_id", "user_id", "event_name", "event_category",
    )
] + [T.StructField("execution_time_ms", T.DoubleType()), T.StructField("_broken", T.StringType())])


def read_utterances(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, trim_fields: bool = False, multi_line: bool = True
) -> DataFrame:
    """
    CSV with a header, every column a string, rows without a query dropped.

    ``trim_fields`` is the stricter form used before embedding: fields trimmed, blank
    utterances dropped. ``multi_line=False`` lets Spark split large files whose cells
    hold no line breaks.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line, inferSchema=False, lineSep="\n")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    cells = {c: F.when(~F.col(c).isin(MISSING_CELLS), F.col(c)) for c in df.columns}
    df = df.select([v.alias(c) for c, v in cells.items()])
    if trim_fields:
        df = df.select([F.trim(F.col(c)).alias(c) for c in df.columns])
    if "query" in df.columns:
        df = df.filter(F.col("query").isNotNull())
        if trim_fields:
            df = df.filter(F.col("query") != "")
    return df


def _as_text(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        col = F.col(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        out.append((F.to_json(col) if nested else col).alias(field.name))
    return df.select(out)


def write_cases(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Case rows with every value quoted (csv), or as JSON lines; nested values become JSON text in csv."""
    if format == "csv":
        writer = _as_text(df).write.mode(mode).options(
            header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n"
        )
        writer.csv(path)
    elif format == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"format must be csv or json, not {format!r}")


def read_cases_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """``value`` column of JSON log lines to typed columns; lines that are not JSON keep their text in ``broken``."""
    parsed = F.from_json("value", LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("value", parsed.alias("r"))
    fields: list[Column] = [F.col(f"r.{f.name}").alias(f.name) for f in LOG_SCHEMA.fields if f.name not in ("timestamp", "_broken")]
    return rows.select(
        F.expr("try_to_timestamp(r.timestamp)").alias("ts"),
        *fields,
        F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), F.col("value")).alias("broken"),
    )


def keep_log_rows(rows: DataFrame) -> DataFrame:
    """Readable rows, DEBUG dropped."""
    return rows.filter(F.col("broken").isNull() & (F.coalesce("severity", F.lit("")) != "DEBUG")).drop("broken")


def broken_log_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("broken").isNotNull()).select("broken")


def read_json_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    lines = spark.readStream.text(path) if streaming else spark.read.text(path)
    return keep_log_rows(parse_log_lines(lines))
