"""
Token counts from an exact histogram of encoded lengths.

Documents are counted by length, combined in each task, so one row per distinct length is all that leaves
the scan, and they are stored before they are read several times. Sums over the longer lengths then answer, for every context limit, how many documents fit, how many
tokens a limit keeps and where the quantiles lie. Prefix sums run inside blocks of 1,024 lengths and over
the totals of blocks, so no task holds more than a block or one row per block.

Null and empty texts have length 0. An empty table has no rows. Repeated rows count each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored, texts
from waymark.llm.tokens import byte_encoder

BLOCK = 1024
FILE = "byte_bpe_50k.json"


def _lengths(batches):
    encoder = byte_encoder(FILE)
    for batch in batches:
        counts = [len(encoder.ids(t)) // 4 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["length"])


def histogram(docs: DataFrame) -> DataFrame:
    """length, n_docs: documents by encoded length."""
    encoded = texts(docs).select("text").mapInArrow(_lengths, "length long")
    return encoded.groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """
    Per occurring length, taken as a context limit: n_docs of that length, docs_within (as long or shorter),
    docs_over, tokens_within, tokens_over, kept_tokens (each document cut at the limit), share_within.
    A quantile q is the smallest length whose share_within reaches q.
    """
    hist = stored(hist, "lengths")
    rows = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.partitionBy(F.floor(F.col("block") / BLOCK)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A thousand blocks of a thousand lengths lie in each upper group; one row per million of tokens is summed once more.
    upper = sums.groupBy(F.floor(F.col("block") / BLOCK).alias("top")).agg(F.sum("d").alias("ud"), F.sum("t").alias("ut"))
    above = Window.partitionBy(F.lit(0)).orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = upper.select("top", F.coalesce(F.sum("ud").over(above), F.lit(0)).alias("top_d"), F.coalesce(F.sum("ut").over(above), F.lit(0)).alias("top_t"))
    zero = F.lit(0)
    blocks = sums.select("block", F.coalesce(F.sum("d").over(before), zero).alias("pd"), F.coalesce(F.sum("t").over(before), zero).alias("pt"))
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("*", F.sum("n_docs").over(inside).alias("id"), F.sum("tokens").over(inside).alias("it")).join(blocks, "block")
    placed = placed.withColumn("top", F.floor(F.col("block") / BLOCK)).join(tops, "top")
    total = hist.agg(F.sum("n_docs").alias("all_d"), F.sum(F.col("length") * F.col("n_docs")).alias("all_t"))
    within = placed.select("length", "n_docs", (F.col("id") + F.col("pd") + F.col("top_d")).alias("docs_within"), (F.col("it") + F.col("pt") + F.col("top_t")).alias("tokens_within"))
    joined = within.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    over = F.col("all_d") - F.col("docs_within")
    return joined.select(
        "length", "n_docs", "docs_within", over.alias("docs_over"), "tokens_within", (F.col("all_t") - F.col("tokens_within")).alias("tokens_over"),
        (F.col("tokens_within") + F.col("length") * over).alias("kept_tokens"), (F.col("docs_within") / F.col("all_d")).alias("share_within"),
    )
