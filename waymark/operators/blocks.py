"""
Scoring every request against every item without ever forming the pairs as rows.

Two layouts, same result:

* few requests: they travel to the items. Their number and bytes are checked first; each
  task keeps the best k per request over all its batches, so items are never shuffled.
* many requests: they are cut into blocks of bounded size, the items into a few groups, and each (group,
  block) cell is one run of rows of a task: the block is held, the group passes by in slices. A hot key is
  split over many cells. Requests are copied once a group, of which there are few however many the items,
  and items once a block.

Only the best k items per request leave a cell; a window then picks the overall best.
Scores are rounded to nine digits before ranking, ties go to the smaller item id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import checkpointed

SCORE_DIGITS = 9
MAX_TRAVELLING_REQUESTS = 2_000
MAX_TRAVELLING_BYTES = 32 << 20
BLOCK_ROWS, BLOCK_BYTES = 32_768, 64 << 20  # of requests held in a task
ITEM_ROWS = 16_384  # of a slice that passes by
SPREAD_BLOCKS, SPREAD_ROWS = 6, 1_024  # blocks of a key, of so many rows at least, whatever fits one; groups of items at most
TILE_ROWS, TILE_ITEMS, FIRST_ITEMS = 512, 4_096, 2_048  # scores held at once in a task
PARTS_A_CORE, LEAST_PARTS = 64, 1_024  # cells are dealt over at most so many tasks, whichever is more
BROADCAST_ROWS = 200_000  # results up to this many rows may be broadcast by whoever joins them

# score(requests, items) reads both sides once and gives scores(rows, cols): the matrix of a slice of each. If that has
# rough(rows, cols), a matrix of scores off by ``error`` at most, tiles are looked through by it and only what may be among
# the best is scored by at(rows, cols), one score for each two places.
Scores = Callable[[slice, slice], np.ndarray]
Scorer = Callable[[pa.Table, pa.Table], Scores]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a 2-D array; rows of different width are an error."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) == 0:
        return np.zeros((0, 0))
    widths = np.unique(pc.list_value_length(flat).to_numpy(zero_copy_only=False))
    if len(widths) != 1:
        raise ValueError(f"vectors of different dimensions in one group: {widths.tolist()}")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def normalised(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.clip(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9, None)


def cosine_scorer(requests: pa.Table, items: pa.Table) -> Scores:
    q, v = matrix(requests["_load"]), matrix(items["_load"])
    if q.shape[1] != v.shape[1]:
        raise ValueError(f"query vector dimension {q.shape[1]} != expected {v.shape[1]}")
    return Cosine(normalised(q), normalised(v))


class Cosine:
    """Inner products of unit vectors; rough ones in single precision, which are twice as fast."""

    def __init__(self, q: np.ndarray, v: np.ndarray):
        self.q, self.v, self.q32, self.v32 = q, v, q.astype(np.float32), v.astype(np.float32)
        # the sum of so many rounded products of unit vectors, each rounded itself
        self.error = (q.shape[1] + 8) * float(np.finfo(np.float32).eps)

    def __call__(self, rows, cols) -> np.ndarray:
        return self.q[rows] @ self.v[cols].T

    def rough(self, rows, cols) -> np.ndarray:
        return self.q32[rows] @ self.v32[cols].T

    def at(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.q[rows], self.v[cols])


def id_order(ids: np.ndarray) -> np.ndarray:
    """Position of each id in sorted order, so any id type can break ties; numbers are their own order."""
    if ids.dtype.kind in "iu":
        return ids
    order = np.empty(len(ids), dtype=np.int64)
    order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return order


def best_k(q_idx: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each request."""
    order = np.lexsort((id_order(ids), -scores, q_idx))
    sorted_q = q_idx[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_q)) + 1]) if len(order) else np.array([], dtype=int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each true entry, by row: one axis is searched much faster than two, eight entries at once faster still."""
    flat = found.ravel()
    if flat.size % 8 == 0:
        some = np.flatnonzero(flat.view(np.uint64))
        at = (some[:, None] * 8 + np.arange(8)).ravel()
        at = at[flat[at]]
    else:
        at = np.flatnonzero(flat)
    return np.divmod(at, found.shape[1])


def _same_ids(q_ids: np.ndarray, item_ids: np.ndarray):
    """(request position, item position) of all pairs with equal ids, by request; a null equals nothing."""
    known = np.flatnonzero(~pd.isna(item_ids))
    by_id = known[np.argsort(item_ids[known], kind="stable")]
    asked = np.flatnonzero(~pd.isna(q_ids))
    low, high = (np.searchsorted(item_ids[by_id], q_ids[asked], side) for side in ("left", "right"))
    n = high - low
    at = np.arange(n.sum()) + np.repeat(low - (n.cumsum() - n), n)
    return np.repeat(asked, n), by_id[at]


def _candidates(requests: pa.Table, items: pa.Table, scorer: Scorer, k: int, positive: bool, skip_self: bool, best=None):
    """
    (request position, item id, score) of the k best of each request, in tiles of requests and items.

    Past the first tile only scores that reach the request's k-th best so far are looked at. ``best`` has the like of
    items seen before, by request and best first; the result are then the new ones that may be among the k best.
    """
    item_ids, q_ids = items["_id"].to_numpy(), requests["_id"].to_numpy()
    scores_of = scorer(requests, items)
    tile_of, error = getattr(scores_of, "rough", scores_of), getattr(scores_of, "error", 0.0)
    slack = 2 * 10.0**-SCORE_DIGITS + 2 * error
    own_q, own_i = _same_ids(q_ids, item_ids) if skip_self else (np.zeros(0, np.int64),) * 2
    out = []
    for first in range(0, len(q_ids), TILE_ROWS):
        rows = slice(first, min(first + TILE_ROWS, len(q_ids)))
        here = slice(*np.searchsorted(own_q, [rows.start, rows.stop]))
        mine_q, mine_i = own_q[here] - first, own_i[here]
        floor = np.full((rows.stop - first, 1), 0.4 * 10.0**-SCORE_DIGITS - error if positive else -float(np.finfo(np.float32).max))
        primed = False
        if best is not None:
            known = slice(*np.searchsorted(best[0], [rows.start, rows.stop]))
            held = best[0][known] - first
            full = np.flatnonzero(np.bincount(held, minlength=len(floor)) >= k)
            floor[full, 0] = np.maximum(floor[full, 0], best[2][known][np.searchsorted(held, full, "right") - 1] - slack)
            primed = len(full) == len(floor)
        kept = None
        # a short first tile gives the floors
        edges = [0, *range(min(FIRST_ITEMS, len(item_ids)), len(item_ids), TILE_ITEMS), len(item_ids)]
        for start, stop in zip(edges, edges[1:]):
            cols = slice(start, stop)
            scores = tile_of(rows, cols)
            inside = (mine_i >= start) & (mine_i < stop)
            scores[mine_q[inside], mine_i[inside] - start] = -np.inf
            if kept is None and not primed and scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]].astype(float) - slack)
            # a floor rounded to the precision of a rough tile moves by less than the slack's spare half
            qi, ii = _places(scores >= floor.astype(scores.dtype))
            exact = scores[qi, ii] if tile_of is scores_of else scores_of.at(first + qi, start + ii)
            values = np.round(exact, SCORE_DIGITS)
            if positive:
                some = values > 0
                qi, ii, values = qi[some], ii[some], values[some]
            if kept is not None and not len(qi):
                continue
            found = (qi, item_ids[start + ii], values)
            kept = found if kept is None else tuple(np.concatenate(x) for x in zip(kept, found))
            keep = best_k(*kept, k)
            kept = tuple(x[keep] for x in kept)
            # sorted by request, best first: the last of k rows is its floor, less what rounding may hide
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(floor)) >= k)
            floor[full, 0] = np.maximum(floor[full, 0], kept[2][np.searchsorted(kept[0], full, "right") - 1] - slack)
        if kept is not None:
            out.append((kept[0] + first, *kept[1:]))
    if not out:
        return np.zeros(0, np.int64), item_ids[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _as_arrow(requests: pa.Table, found, key: str, schema: pa.Schema) -> pa.Table:
    qi, ids, scores = found
    return pa.table(
        {
            "_key": pa.array([key] * len(qi), pa.string()),
            "_q": requests["_id"].combine_chunks().take(pa.array(qi)),
            "_item": pa.array(ids.tolist(), schema.field("_item").type),
            "_score": pa.array(scores, pa.float64()),
        },
        schema=schema,
    )


def _travelling(requests: pa.Table, scorer: Scorer, k: int, positive: bool, skip_self: bool, schema: pa.Schema):
    by_key = {key: requests.filter(pc.equal(requests["_key"], key)) for key in pc.unique(requests["_key"]).to_pylist()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in pc.unique(table["_key"]).to_pylist():
                if key not in by_key:
                    continue
                items = table.filter(pc.equal(table["_key"], key))
                found = _candidates(by_key[key], items, scorer, k, positive, skip_self)
                if key in best:
                    found = tuple(np.concatenate(x) for x in zip(best[key], found))
                    keep = best_k(*found, k)
                    found = tuple(x[keep] for x in found)
                best[key] = found
        for key, found in best.items():
            yield from _as_arrow(by_key[key], found, key, schema).to_batches()

    return scan


def load_bytes(kind: T.DataType) -> Column:
    """About what the load of a row takes."""
    load = F.col("_load")
    if isinstance(kind, T.BinaryType):
        size = F.octet_length(load)
    elif isinstance(kind, T.ArrayType):
        size = F.size(load) * (4 if isinstance(kind.elementType, T.FloatType) else 8)
    else:
        size = F.size("_load.terms") * 16
    return F.coalesce(size, F.lit(0)).cast("long")


def block_count(df: DataFrame, rows: int, name: str, bytes_of: Column | None = None) -> DataFrame:
    """
    Blocks each key needs so that none holds many more than ``rows`` rows, or BLOCK_BYTES if ``bytes_of`` a row is given.
    A key of few blocks is cut further, or its few cells would be the job's longest tasks.
    """
    n = F.count("*")
    wanted = [F.ceil(n / F.lit(rows)), F.least(F.lit(SPREAD_BLOCKS), F.ceil(n / F.lit(SPREAD_ROWS)))]
    if bytes_of is not None:
        wanted.append(F.ceil(F.sum(bytes_of) / F.lit(BLOCK_BYTES)))
    return df.groupBy("_key").agg(F.greatest(*wanted).cast("int").alias(name))


def block_of(id_col: str, n_blocks: str):
    return F.pmod(F.xxhash64(id_col), F.col(n_blocks)).cast("int")


def cell_parts(df: DataFrame, cells: int) -> int:
    """Tasks for so many cells: more than cells, as they are dealt by hash and should rarely share one."""
    return max(1, min(2 * cells, max(LEAST_PARTS, PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)))


def dealt(cells: DataFrame, parts: int, *keys: str):
    """
    Rows grouped by cell, in a fixed number of tasks. A cell's work grows with the product of its sides, which are few
    bytes; left to itself Spark would merge the cells into the few tasks that fit their bytes.
    """
    return cells.repartition(parts, *keys).groupBy(*keys)


def _stream(scorer: Scorer, k: int, positive: bool, skip_self: bool, rows: int, schema: pa.Schema):
    """Cells one after the other, a cell's requests before its items: those are held, these are scored ``rows`` at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, waiting, n, requests, best = None, [], [], 0, None, None

        def score() -> None:
            nonlocal waiting, n, requests, best
            if requests is None and asked:
                requests = _side(asked, "q")
                asked.clear()
            if requests is not None and waiting:
                found = _candidates(requests, _side(waiting, "i"), scorer, k, positive, skip_self, best)
                if best is not None:
                    found = tuple(np.concatenate(x) for x in zip(best, found))
                    keep = best_k(*found, k)
                    found = tuple(x[keep] for x in found)
                best = found
            waiting, n = [], 0

        for batch in batches:
            for ident, side, part in _runs(batch):
                if ident != cell:
                    score()
                    if best is not None:
                        yield from _as_arrow(requests, best, cell[0], schema).to_batches()
                    cell, requests, best = ident, None, None
                    asked.clear()
                if side == 0:
                    asked.append(part)
                    continue
                while part.num_rows:
                    waiting.append(part.slice(0, rows - n))
                    n, part = n + waiting[-1].num_rows, part.slice(rows - n)
                    if n >= rows:
                        score()
        score()
        if best is not None:
            yield from _as_arrow(requests, best, cell[0], schema).to_batches()

    return scan


def _runs(batch: pa.RecordBatch):
    """(cell, side, rows) of each stretch of rows alike."""
    if not batch.num_rows:
        return
    keys = batch.column("_key").dictionary_encode()
    columns = [keys.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("_ib", "_qb", "_side"))]
    edges = np.r_[0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1, batch.num_rows]
    for start, stop in zip(edges.tolist(), edges[1:].tolist()):
        code, ib, qb, side = (int(x[start]) for x in columns)
        yield (keys.dictionary[code].as_py(), ib, qb), side, batch.slice(start, stop - start)


def _side(parts: list[pa.RecordBatch], name: str) -> pa.Table:
    table = pa.Table.from_batches(parts)
    return pa.table({"_id": pc.struct_field(table["_id"], name), "_load": table["_load"]})


def _grid(requests: DataFrame, items: DataFrame, scorer: Scorer, k: int, positive: bool, skip_self: bool, rows: int, schema: pa.Schema, ddl: str):
    # a row a key; read for the number of cells and by both sides
    asked = block_count(requests, rows, "_nq", load_bytes(requests.schema["_load"].dataType))
    cores = requests.sparkSession.sparkContext.defaultParallelism
    # so many groups that there are two cells a core
    groups = F.least(F.col("_ni"), F.greatest(F.lit(SPREAD_BLOCKS), F.ceil(F.lit(2 * cores) / F.col("_nq")).cast("int")))
    blocks = checkpointed(block_count(items, rows, "_ni").join(asked, "_key").withColumn("_ni", groups))
    n_keys, n_cells = blocks.agg(F.count("*"), F.coalesce(F.sum(F.col("_ni").cast("long") * F.col("_nq")), F.lit(0))).first()
    if n_keys <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)

    def cells(df: DataFrame, mine: str, theirs: str, count: str, other: str, side: int) -> DataFrame:
        return df.join(blocks, "_key").select(
            "_key", block_of("_id", count).alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs),
            "_id", "_load", F.lit(side).alias("_side"),
        )

    q = cells(requests, "_qb", "_ib", "_nq", "_ni", 0).withColumn("_id", F.struct(F.col("_id").alias("q"), F.lit(None).cast(items.schema["_id"].dataType).alias("i")))
    v = cells(items, "_ib", "_qb", "_ni", "_nq", 1).withColumn("_id", F.struct(F.lit(None).cast(requests.schema["_id"].dataType).alias("q"), F.col("_id").alias("i")))
    # a cell's work grows with the product of its sides, which are few bytes: a fixed number of tasks, or Spark would merge them
    dealt_cells = q.unionByName(v).repartition(cell_parts(requests, n_cells), "_key", "_ib", "_qb")
    return dealt_cells.sortWithinPartitions("_key", "_ib", "_qb", "_side").mapInArrow(_stream(scorer, k, positive, skip_self, min(rows, ITEM_ROWS), schema), ddl)


def top_k_blocked(
    requests: DataFrame, items: DataFrame, scorer: Scorer, k: int, keys: list[str], request_id: str, item_id: str, load: str,
    positive: bool = False, skip_self: bool = False, layout: str = "auto", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """
    The k best items of each request among those with equal ``keys``:
    (keys..., request_id, item_id, score, rank). A null key matches nothing.
    """
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    for name in keys:
        requests, items = requests.filter(F.col(name).isNotNull()), items.filter(F.col(name).isNotNull())
    q = requests.select(key.alias("_key"), F.col(request_id).alias("_id"), F.col(load).alias("_load"))
    v = items.select(key.alias("_key"), F.col(item_id).alias("_id"), F.col(load).alias("_load"))
    q_type, i_type = q.schema["_id"].dataType, v.schema["_id"].dataType
    ddl = f"_key string, _q {q_type.simpleString()}, _item {i_type.simpleString()}, _score double"
    names = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("_key", pa.string()), ("_q", names[q_type.simpleString()]), ("_item", names[i_type.simpleString()]), ("_score", pa.float64())])

    travelling = None
    if layout in ("auto", "travel"):
        sample = q.limit(MAX_TRAVELLING_REQUESTS + 1).toArrow()
        small = len(sample) <= MAX_TRAVELLING_REQUESTS and sample.nbytes <= MAX_TRAVELLING_BYTES
        if layout == "travel" and not small:
            raise ValueError("too many requests to send to every task")
        travelling = sample.cast(pa.schema([f if f.name != "_id" else pa.field("_id", schema.field("_q").type) for f in sample.schema])) if small else None
    if travelling is not None:
        found = v.mapInArrow(_travelling(travelling, scorer, k, positive, skip_self, schema), ddl) if len(travelling) else v.sparkSession.createDataFrame([], ddl)
    else:
        found = _grid(q, v, scorer, k, positive, skip_self, block_rows, schema, ddl)

    order = W.partitionBy("_key", "_q").orderBy(F.col("_score").desc(), F.col("_item"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if keys:
        types = ", ".join(f"`{name}` {requests.schema[name].dataType.simpleString()}" for name in keys)
        best = best.withColumn("_k", F.from_json("_key", f"struct<{types.replace('` ', '`:')}>"))
    if travelling is not None and len(travelling) * k <= BROADCAST_ROWS:
        # at most requests x k rows, both known here: joining them must not shuffle the items
        best = F.broadcast(best)
    return best.select(
        *[F.col(f"_k.{name}").alias(name) for name in keys], F.col("_q").alias(request_id),
        F.col("_item").alias(item_id if item_id != request_id else f"item_{item_id}"), F.col("_score").alias("score"), "rank",
    )
