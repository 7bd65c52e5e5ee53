"""
Exact duplicates by content sort.

Rows are range-partitioned by sampled splitters over (start of the text, hash of the text, id) and sorted
outside memory with the whole text in the order, so equal texts are neighbours, and a text that a third of
the rows share is still cut over many tasks. Each task compares every text in full with its neighbour. A run
of equal texts that touches an edge of its task may go on in the next: only the runs at edges, at most two
a task, are put together by digest.

Null texts count as empty; rows repeated with their id are copies of each other (each counts in group_size,
and each row with the largest id stays); a null id sorts below every other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored, texts

SCHEMA = "doc_id long, keep_id long, group_size long, text_sha256 string, part int, edge boolean, head boolean"
EMIT = 50_000


def _runs(batches):
    """
    One row per document of a sorted partition. Of a run only ids are held, never texts, and a run ends with
    its partition, so memory is bounded by the partition. The first id is the largest.
    """
    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
    out = [[] for _ in names]

    def close(ids, text, edge):
        digest, n = hashlib.sha256(text.encode("utf-8")).hexdigest(), len(ids)
        for column, values in zip(out, (ids, [ids[0]] * n, [n] * n, [digest] * n, [part] * n, [edge] * n, [True] + [False] * (n - 1))):
            column.extend(values)

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        for column in out:
            column.clear()
        return batch

    ids, text, first = [], None, True
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if value != text and text is not None:
                close(ids, text, first)
                ids, first = [], False
                if len(out[0]) >= EMIT:
                    yield flush()
            text = value
            ids.append(key)
    if text is not None:
        close(ids, text, True)
    if out[0]:
        yield flush()


def exact_duplicates(docs: DataFrame, partitions: int | None = None, prefix: int = 64) -> DataFrame:
    """
    doc_id, keep_id, group_size, kept and text_sha256 of every row; the row with the largest id stays.

    ``prefix`` code points of a text serve as its splitter; the sort and the comparison take all of it.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts(docs).select("doc_id", "text", F.substring("text", 1, prefix).alias("start"), F.xxhash64("text").alias("hash"))
    last = F.col("doc_id").desc_nulls_last()
    placed = keyed.repartitionByRange(partitions, "start", "hash", last).sortWithinPartitions("start", "hash", "text", last)
    runs = stored(placed.select("doc_id", "text").mapInArrow(_runs, SCHEMA), "runs")
    # Two rows a task at most: small enough to send everywhere.
    edges = (
        runs.filter("edge and head").groupBy("text_sha256")
        .agg(F.max("keep_id").alias("edge_keep"), F.sum("group_size").alias("edge_size")).withColumn("edge", F.lit(True))
    )
    whole = runs.join(F.broadcast(edges), ["text_sha256", "edge"], "left")
    keep, size = F.when(F.col("edge"), F.col("edge_keep")).otherwise(F.col("keep_id")), F.coalesce("edge_size", "group_size")
    return whole.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
