"""
Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers. A block of candidates keeps each component, shifted to be non-negative, as bit slices:
one bitmap per bit. A query adds slices with full adders on bitmaps, by weight, the complement standing in for negative
factors; the sum is itself a set of slices. The best rows are then selected from the most significant slice down, and
rows that still tie at the boundary are settled by id. Scores of the selected rows are taken from the integers.

Queries and candidates meet in a grid of bounded blocks, so no task holds more than one block of each, and k rows per
query and block leave it. Vectors that are null or hold a null or non-finite component take no part; vectors of
different width never meet. A query's own row is every row of its id; repeated queries are asked once, repeated candidates
count each. Rows without id take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 32_768
QUERIES = 2_048


def _quantised(batches, scale):
    for batch in batches:
        ids, widths, data = [], [], []
        for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) if vector.is_valid else None
            if key is None or values is None or not np.isfinite(values).all():
                continue
            ids.append(key)
            widths.append(len(values))
            data.append(np.floor(scale * values).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "width", "cells"])


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, width and ``cells`` (floor(scale * x) as 64-bit integers) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(partial(_quantised, scale=scale), "vec_id long, width int, cells binary")


class SlicedIndex:
    """Bit slices of a block of integer vectors, rows in the order given."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.low = values.min(0) if len(values) else np.zeros(values.shape[1], np.int64)
        shifted = values - self.low
        self.depth = np.array([int(m).bit_length() for m in shifted.max(0)])
        words = -(-self.rows // 64) * 64
        padded = np.zeros((words, values.shape[1]), np.int64)
        padded[: self.rows] = shifted
        self.slices = [
            [np.packbits(((padded[:, d] >> b) & 1).astype(bool)).view(np.uint64) for b in range(self.depth[d])] for d in range(values.shape[1])
        ]
        self.exists = np.packbits(np.arange(words) < self.rows).view(np.uint64)

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the inner products with ``query``, lowest first, each less the same constant."""
        waiting: dict[int, list[np.ndarray]] = {}
        for slices, factor in zip(self.slices, query.tolist()):
            size, bit = abs(factor), 0
            while size >> bit:
                if size >> bit & 1:
                    for b, one in enumerate(slices):
                        waiting.setdefault(bit + b, []).append(one if factor > 0 else ~one)
                bit += 1
        out, weight = [], 0
        while waiting:
            level = waiting.pop(weight, [])
            stack = np.array(level or [np.zeros_like(self.exists)])
            carried = []
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (c & half))
                stack = np.concatenate([half ^ c, stack[3 * n :]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0])
            if carried:
                waiting.setdefault(weight + 1, []).extend(np.concatenate(carried))
            weight += 1
        return out

    def best(self, query: np.ndarray, k: int, exists: np.ndarray) -> np.ndarray:
        """Positions of the k best rows among ``exists``; ties go to the earlier position."""
        chosen, tied = np.zeros_like(exists), exists
        if int(np.bitwise_count(exists).sum()) > k:
            for one in reversed(self.add(query)):
                higher = tied & one
                n = int(np.bitwise_count(chosen | higher).sum())
                if n > k:
                    tied = higher
                else:
                    chosen, tied = chosen | higher, tied & ~one
                    if n == k:
                        tied = np.zeros_like(tied)
                        break
        sure = np.flatnonzero(np.unpackbits(chosen.view(np.uint8)))
        edge = np.flatnonzero(np.unpackbits(tied.view(np.uint8)))
        return np.r_[sure, edge[: k - len(sure)]]


def _matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame["cells"]), "<i8").reshape(len(frame), width) if width else np.zeros((len(frame), 0), np.int64)


def _answer(key, queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(items):
        width = int(key[0])
        items = items.sort_values("vec_id", kind="stable")
        ids, values = items["vec_id"].to_numpy(), _matrix(items, width)
        index = SlicedIndex(values)
        for one, query in zip(queries["vec_id"].to_numpy(), _matrix(queries, width)):
            begin, stop = np.searchsorted(ids, one, "left"), np.searchsorted(ids, one, "right")
            exists = index.exists
            if stop > begin:
                others = np.unpackbits(exists.view(np.uint8))
                others[begin:stop] = 0
                exists = np.packbits(others).view(np.uint64)
            at = index.best(query, k, exists)
            out.append(pd.DataFrame({"query_id": one, "vec_id": ids[at], "score": values[at] @ query}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose id is divisible by ``every``."""
    cells = quantise(vectors, scale)
    n, asked = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    across, down = -(-n // rows) or 1, -(-asked // queries) or 1
    place = F.xxhash64(F.monotonically_increasing_id())
    items = cells.withColumn("row", F.pmod(place, F.lit(across).cast("long"))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    wanted = cells.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "cells"]).withColumn("column", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int"))
    wanted = wanted.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    grid = ["width", "row", "column"]
    found = wanted.groupBy(*grid).cogroup(items.groupBy(*grid)).applyInPandas(
        lambda key, a, b: _answer(key, a, b, k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
