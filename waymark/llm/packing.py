"""
Best-fit packing planned on the histogram of lengths.

The plan is best-fit decreasing over counts: at most ``capacity`` distinct lengths, whatever the number of
documents. It names, for every length, which ranks go to which sequences at which place. Pieces then take
planned places by their rank within their length: a task counts its own pieces by length while it encodes, and
sums of those counts over the tasks before it turn the local rank into the rank in the table.

Null texts are empty documents: the end token alone. Repeated rows are packed each. Documents longer than
the capacity are cut from their end, so only the first piece may be short. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored, texts
from waymark.llm.tokens import byte_encoder

FILE = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024


def _pieces(batches, file, capacity, end):
    encoder, tail = byte_encoder(file), np.array([end], "<u4").tobytes()
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = memoryview(encoder.ids(text) + tail)
            n = len(ids) // 4
            first = n % capacity or capacity
            for piece, stop in enumerate(range(first, n + 1, capacity)):
                start = max(0, stop - capacity) if piece else 0
                length = stop - start
                rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), part, int(seen[length])))
                seen[length] += 1
        columns = list(zip(*rows)) or [[]] * len(names)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int]]]:
    """
    For each length, runs of (places, first sequence, offset): the next ``places`` ranks of the length go to
    that many sequences from the first on, at that offset. Bins alike are held as one group of (room, first, n).
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    groups: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, out = counts[length], runs.setdefault(length, [])

        def place(first, n, room, each, length=length, out=out):
            for i in range(each):
                out.append((n, first, capacity - room + i * length))
            groups.setdefault(room - each * length, []).append((first, n))

        while left:
            room = min((r for r in groups if r >= length and groups[r]), default=None)
            if room is None:
                each, n, first = min(capacity // length, left), max(1, left // (capacity // length)), opened
                opened += n
                place(first, n, capacity, each)
                left -= each * n
                continue
            first, n = groups[room].pop()
            each = min(room // length, left)
            used = min(n, max(1, left // each))
            if used < n:
                groups[room].append((first + used, n - used))
            place(first, used, room, each)
            left -= each * used
    return runs


def _placed(batches, planned):
    table = planned.value
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("base").to_numpy() + batch.column("local").to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            begins, firsts, offsets = table[int(one)]
            run = np.searchsorted(begins, rank[at], "right") - 1
            sequence[at], offset[at] = firsts[run] + rank[at] - begins[run], offsets[run]
        kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, file: str = FILE, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = partial(_pieces, file=file, capacity=capacity, end=end)
    pieces = stored(texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    # At most ``capacity`` rows come back.
    runs = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = {}
    for length, parts in runs.items():
        n, firsts, offsets = (np.array(x, np.int64) for x in zip(*parts))
        table[length] = (np.r_[0, n.cumsum()[:-1]], firsts, offsets)
    planned = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "local", "base").mapInArrow(
        partial(_placed, planned=planned), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
