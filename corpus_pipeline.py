"""Documents to packed training sequences: toxic documents out, repeated lines out, one document per near copy, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import lines, packing, simhash, toxicity
from waymark.llm.common import spare, stored
from waymark.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier does not reject."""
    machine = toxicity.fit(*toxicity.sample_terms(docs, table(spark, sf_dir, "labels")))
    score = spare(docs, "score")
    return toxicity.score_texts(docs, machine, docs.columns, score).filter(F.col(score) < 0.5).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the lines that a document of smaller id holds."""
    gone = lines.repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    key, drop = spare(docs, "_id"), spare(docs, "drop")
    gone = gone.select(F.col("doc_id").alias(key), F.col("drop").alias(drop))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(lines.NO_ID))).join(gone, key, "left").drop(key)
    return lines.without(keyed, drop)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each of op7's groups of near copies: that of the smallest id, a null id last."""
    keys = [spare(docs, n) for n in ("_no_id", "_id", "_hash")]
    of_row = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(lines.NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))]
    # texts go by their hash: ids may repeat or be null
    found = simhash.near_duplicates(docs.select(of_row[2].alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("hash"), F.col("component_id").alias("root")).distinct()
    least = docs.select(of_row[2].alias("hash"), F.struct(of_row[0].alias("no_id"), of_row[1].alias("id")).alias("row")).groupBy("hash").agg(F.min("row").alias("row"))
    firsts = least.join(groups, "hash").groupBy("root").agg(F.min(F.struct("row.no_id", "row.id", "hash")).alias("first"))
    kept = firsts.select(*[F.col(f"first.{n}").alias(key) for n, key in zip(("no_id", "id", "hash"), keys)])
    # the same text under the same id is one row more than once
    return docs.withColumns(dict(zip(keys, of_row))).join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", one_of_near_copies), ("packing", pack)]

# A fitted classifier decides in the first stage: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
