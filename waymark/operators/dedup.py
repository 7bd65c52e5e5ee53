"""
Greedy near-duplicate removal and similarity calibration.

A row is dropped when its cosine to an earlier *accepted* row of its bucket reaches the
threshold. Rows are taken in arrival order, so the result is that of the sequential rule:

* exact copies of a vector collapse first: all but the earliest would be dropped anyway, so
  a large group of copies costs one aggregated row;
* a bucket that fits one block is decided in one task, row by row;
* a larger bucket is decided in parallel rounds. A row with no undecided earlier neighbour is
  accepted, undecided rows near an accepted earlier one are dropped, until the rest fits one
  block. Neighbours are looked for in cells of two blocks, and a cell returns at most one
  record per row, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.blocks import block_count, block_of, cell_parts, dealt, matrix, normalised
from waymark.operators.dense import cosine
from waymark.session import checkpointed

# Default threshold and the bands of the report.
THRESHOLD = 0.92
HIGH_RATE, LOW_RATE, LOW_RATE_ROWS = 0.45, 0.02, 100
BLOCK_ROWS = 8_192
CELL_ROWS = 4_096  # of a block of the rounds, at least
TILE = 1_024  # rows of either side compared at once in a task
ROUNDED_COPY = 1e-6  # a copy of a vector is only sure to reach thresholds below 1 - this

_IDS = pa.schema([("_key", pa.string()), ("_ord", pa.int64())])
_IDS_DDL = "_key string, _ord bigint"


def _greedy(table: pa.Table, threshold: float) -> pa.Table:
    """Orders of the accepted rows of one bucket."""
    ords = table["_ord"].to_numpy()
    by_arrival = np.argsort(ords, kind="stable")
    vecs = normalised(matrix(table["_vec"]))[by_arrival]
    dropped = np.zeros(len(vecs), dtype=bool)
    for i in range(len(vecs)):
        if not dropped[i] and i + 1 < len(vecs):
            rest = np.flatnonzero(~dropped[i + 1 :]) + i + 1
            dropped[rest] = vecs[rest] @ vecs[i] >= threshold
    kept = ords[by_arrival][~dropped]
    return pa.table({"_key": pa.array([table["_key"][0].as_py()] * len(kept), pa.string()), "_ord": pa.array(kept, pa.int64())}, schema=_IDS)


def _near_earlier(mine: pa.Table, theirs: pa.Table, threshold: float) -> np.ndarray:
    """Which of ``mine`` have an earlier row of ``theirs`` within the threshold, in tiles; a row found is compared no further."""
    m_ord, t_ord = mine["_ord"].to_numpy(), theirs["_ord"].to_numpy()
    order = np.argsort(t_ord, kind="stable")
    t_ord, t_vec, m_vec = t_ord[order], normalised(matrix(theirs["_vec"]))[order], normalised(matrix(mine["_vec"]))
    hit = np.zeros(len(mine), dtype=bool)
    for first in range(0, len(mine), TILE):
        rest = np.arange(first, min(first + TILE, len(mine)))
        for start in range(0, len(t_ord), TILE):
            rest = rest[m_ord[rest] > t_ord[start]]
            if not len(rest):
                break
            part = slice(start, start + TILE)
            near = m_vec[rest] @ t_vec[part].T >= threshold
            near &= t_ord[part][None, :] < m_ord[rest][:, None]
            found = near.any(axis=1)
            hit[rest[found]] = True
            rest = rest[~found]
    return hit


def _has_earlier_neighbour(rows: DataFrame, others: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """
    (key, order) of the ``rows`` that have an earlier row of ``others`` within the threshold.
    Both sides are cut into blocks; a cell compares one block with one block.
    """
    blocks = checkpointed(block_count(rows, block_rows, "_nr").join(block_count(others, block_rows, "_no"), "_key"))
    n_cells = blocks.agg(F.coalesce(F.sum(F.col("_nr").cast("long") * F.col("_no")), F.lit(0))).first()[0]

    def cells(df: DataFrame, mine: str, theirs: str, own: str, other: str, side: int) -> DataFrame:
        return df.join(blocks, "_key").select(
            "_key", block_of("_ord", own).alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs), "_ord", "_vec", F.lit(side).alias("_side")
        )

    both = cells(rows, "_rb", "_ob", "_nr", "_no", 0).unionByName(cells(others, "_ob", "_rb", "_no", "_nr", 1))

    def compare(table):
        side = table["_side"].to_numpy()
        mine, theirs = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if len(mine) == 0 or len(theirs) == 0:
            return _IDS.empty_table()
        hit = _near_earlier(mine, theirs, threshold)
        return mine.filter(pa.array(hit)).select(["_key", "_ord"]).cast(_IDS)

    return dealt(both, cell_parts(rows, n_cells), "_key", "_rb", "_ob").applyInArrow(compare, _IDS_DDL).distinct()


def accepted_rows(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, order) of the rows the greedy rule accepts, from (_key, _ord, _vec)."""
    accepted = None
    undecided = checkpointed(vectors)

    def add(part: DataFrame) -> None:
        nonlocal accepted
        accepted = part if accepted is None else accepted.unionByName(part)

    while True:
        sizes = undecided.groupBy("_key").agg((F.count("*") > block_rows).alias("_large"))
        sized = undecided.join(sizes, "_key")
        small = sized.filter(~F.col("_large")).drop("_large")
        # rows near an accepted row of an earlier round are gone, so what is left decides itself;
        # cells are of full size however small the rest that ends the rounds, or each row would be in very many
        add(small.groupBy("_key").applyInArrow(lambda t: _greedy(t, threshold), _IDS_DDL))
        large = checkpointed(sized.filter("_large").drop("_large"))
        if large.isEmpty():
            return accepted
        waiting = checkpointed(_has_earlier_neighbour(large, large, threshold, max(block_rows, CELL_ROWS)))
        chosen = large.join(waiting, ["_key", "_ord"], "left_anti")
        rest = large.join(waiting, ["_key", "_ord"], "left_semi")
        covered = _has_earlier_neighbour(rest, chosen, threshold, max(block_rows, CELL_ROWS))
        add(chosen.select("_key", "_ord"))
        undecided = checkpointed(rest.join(covered, ["_key", "_ord"], "left_anti"))


def semantic_dedup(
    rows: DataFrame, order: str, vector: str = "embedding", bucket: tuple[str, ...] = ("t_id", "scenario_type"), threshold: float = THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with a ``kept`` flag. ``order`` is a unique integer giving the order of arrival."""
    key = F.to_json(F.struct(*[F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias(b) for b in bucket]))
    keyed = rows.withColumn("_key", key)
    slim = keyed.select("_key", F.col(order).cast("bigint").alias("_ord"), F.col(vector).alias("_vec"))
    if threshold <= 1 - ROUNDED_COPY:
        # a zero vector is near nothing, not even its copies, so each stays a row of its own
        own = F.when(F.forall("_vec", lambda x: x == 0), F.col("_ord"))
        slim = slim.groupBy("_key", "_vec", own.alias("_own")).agg(F.min("_ord").alias("_ord")).select("_key", "_ord", "_vec")
    kept = accepted_rows(slim, threshold, block_rows).select("_key", F.col("_ord").alias(order), F.lit(True).alias("_kept"))
    joined = keyed.withColumn(order, F.col(order).cast("bigint")).join(kept, ["_key", order], "left")
    return joined.withColumn("kept", F.col("_kept").isNotNull()).drop("_key", "_kept")


def bucket_report(deduped: DataFrame, bucket: tuple[str, ...] = ("t_id", "scenario_type")) -> DataFrame:
    """Kept and dropped rows per bucket."""
    return deduped.groupBy(*bucket).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def dedup_report(deduped: DataFrame, bucket: tuple[str, ...] = ("t_id", "scenario_type")) -> DataFrame:
    """One row: totals, rate, number of buckets and the warning band."""
    per_bucket = bucket_report(deduped, bucket)
    sums = per_bucket.agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.count("*").alias("buckets"))
    total = F.col("kept") + F.col("dropped")
    rate = F.when(total > 0, F.col("dropped") / total).otherwise(0.0)
    warning = F.when(rate > HIGH_RATE, "very high").when((rate < LOW_RATE) & (total > LOW_RATE_ROWS), "suspiciously low")
    return sums.select(total.alias("total_seen"), "kept", "dropped", "buckets", F.round(rate, 4).alias("dedup_rate"), warning.alias("warning"))


def dropped_examples(
    deduped: DataFrame, order: str, vector: str = "embedding", text: str = "query", bucket: tuple[str, ...] = ("t_id", "scenario_type"), n: int = 5
) -> DataFrame:
    """The first n dropped rows, each beside the most similar row accepted before it."""
    first = deduped.filter(~F.col("kept")).orderBy(order).limit(n)
    lost = first.select(*bucket, F.col(order).alias("dropped_id"), F.substring(text, 1, 90).alias("dropped_text"), F.col(vector).alias("_v"))
    # n rows by definition, so they travel to the accepted ones
    pairs = deduped.filter("kept").join(F.broadcast(lost), list(bucket)).filter(F.col(order) < F.col("dropped_id"))
    scored = pairs.withColumn("sim", F.round(cosine(F.col(vector), F.col("_v")), 9))
    best = F.struct(F.col("sim"), -F.col(order))
    return scored.groupBy("dropped_id", "dropped_text").agg(
        F.max_by(order, best).alias("kept_id"), F.max_by(F.substring(text, 1, 90), best).alias("kept_text"), F.round(F.max("sim"), 4).alias("similarity")
    )


def dedup_batch(batch: DataFrame, accepted: DataFrame, order: str, vector: str = "embedding", bucket: tuple[str, ...] = ("t_id", "scenario_type"),
                threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of a new batch that survive against earlier accepted rows and against each other."""
    key = F.to_json(F.struct(*[F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias(b) for b in bucket]))

    def slim(df: DataFrame, o) -> DataFrame:
        return df.select(key.alias("_key"), o.alias("_ord"), F.col(vector).alias("_vec"))

    # every accepted row counts as earlier than any row of the batch
    covered = _has_earlier_neighbour(slim(batch, F.col(order).cast("bigint")), slim(accepted, F.lit(-1).cast("bigint") - F.col(order)), threshold, block_rows)
    fresh = batch.withColumn("_key", key).withColumn("_ord", F.col(order).cast("bigint")).join(covered, ["_key", "_ord"], "left_anti").drop("_key", "_ord")
    return semantic_dedup(fresh, order, vector, bucket, threshold, block_rows).filter("kept").drop("kept")


# --- calibration ---------------------------------------------------------------------------

BINS = 65_536
NARROW = 1e-12


def _place(values: np.ndarray, low: float, width: float) -> np.ndarray:
    return np.clip((values - low) * (BINS / width), 0, BINS - 1).astype(np.int32)


def _tiles(key, table):
    """Similarities of the pairs of one cell, a tile at a time."""
    i, j = key[0].as_py(), key[1].as_py()
    b, ords, vecs = table["_b"].to_numpy(), table["_ord"].to_numpy(), normalised(matrix(table["_vec"]))
    first, second = np.flatnonzero(b == i), np.flatnonzero(b == j)
    for start in range(0, len(first), TILE):
        for begin in range(0, len(second), TILE):
            rows, cols = first[start : start + TILE], second[begin : begin + TILE]
            sims = vecs[rows] @ vecs[cols].T
            yield sims[ords[rows][:, None] < ords[cols][None, :]] if i == j else sims.ravel()


def _in_cells(vectors: DataFrame, block_rows: int):
    """Groups of two blocks; every unordered pair lies in exactly one."""
    keyed = vectors.withColumn("_key", F.lit(""))
    counted = block_count(keyed, block_rows, "_n").first()
    n = counted["_n"] if counted else 1
    pairs = keyed.withColumn("_n", F.lit(n)).withColumn("_b", block_of("_ord", "_n")).select(
        F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"), "_b", "_ord", "_vec"
    ).select(F.least("_b", "_other").alias("_i"), F.greatest("_b", "_other").alias("_j"), "_b", "_ord", "_vec")
    return dealt(pairs, cell_parts(vectors, n * (n + 1) // 2), "_i", "_j")


WHOLE = (-1.0 - 1e-9, 2.0 + 2e-9)


def _histogram(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Counts of pair similarities in the bins of the whole range, their greatest and sum: (bin, n, high, total)."""
    out = pa.schema([("bin", pa.int32()), ("n", pa.int64()), ("high", pa.float64()), ("total", pa.float64())])

    def count(key, table):
        n, high, total = np.zeros(BINS, np.int64), np.full(BINS, -np.inf), np.zeros(BINS)
        for values in _tiles(key, table):
            if len(values):
                bins = _place(values, *WHOLE)
                n += np.bincount(bins, minlength=BINS)
                # the sum and the greatest of a tile are noted at its greatest value's bin
                top = bins.max()
                high[top], total[top] = max(high[top], values.max()), total[top] + values.sum()
        some = np.flatnonzero(n)
        return pa.table([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(high[some]), pa.array(total[some])], schema=out)

    found = _in_cells(vectors, block_rows).applyInArrow(count, "bin int, n bigint, high double, total double")
    return found.groupBy("bin").agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.sum("total").alias("total"))


def _narrowed(vectors: DataFrame, paths: list[list[tuple]], block_rows: int) -> DataFrame:
    """
    Bins within bins: (range, bin, n, low, high). A path is the (low, width, bin) taken at each step, the last one
    (low, width) alone; a value takes the same steps in every pass, so none is lost at an edge.
    """
    out = pa.schema([("range", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
    wanted = np.zeros(BINS, dtype=bool)
    wanted[[path[0][2] for path in paths]] = True

    def count(key, table):
        parts = [(np.zeros(BINS, np.int64), np.full(BINS, np.inf), np.full(BINS, -np.inf)) for _ in paths]
        for values in _tiles(key, table):
            bins = _place(values, *WHOLE)
            some = wanted[bins]
            values, bins = values[some], bins[some]
            for path, (n, low, high) in zip(paths, parts):
                mine = values[bins == path[0][2]]
                for a, width, at in path[1:-1]:
                    mine = mine[_place(mine, a, width) == at]
                place = _place(mine, *path[-1])
                np.add.at(n, place, 1)
                np.minimum.at(low, place, mine)
                np.maximum.at(high, place, mine)
        held = [np.flatnonzero(n) for n, _, _ in parts]
        cols = [np.concatenate([np.full(len(h), r) for r, h in enumerate(held)]), np.concatenate(held)]
        cols += [np.concatenate([part[c][h] for part, h in zip(parts, held)]) for c in range(3)]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    found = _in_cells(vectors, block_rows).applyInArrow(count, "range int, bin int, n bigint, low double, high double")
    return found.groupBy("range", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _order_statistics(vectors: DataFrame, ranks: list[int], block_rows: int):
    """Values at the given positions of the sorted pair similarities, by narrowing histograms."""
    first = _histogram(vectors, block_rows).orderBy("bin").collect()  # at most BINS rows
    n, mean_sum, top = sum(r["n"] for r in first), sum(r["total"] for r in first), max(r["high"] for r in first)
    ranks = [min(max(r, 0), n - 1) for r in ranks]

    def locate(rows, rank):
        for r in rows:
            if rank < r["n"]:
                return r, rank
            rank -= r["n"]
        raise AssertionError("rank beyond the histogram")

    found: dict[int, float] = {}
    open_: dict[int, tuple[list, int]] = {}

    def settle(rank, path, row, inner):
        if row["high"] - row["low"] <= NARROW or inner == 0:
            found[rank] = row["low"]
        elif inner == row["n"] - 1:
            found[rank] = row["high"]
        else:
            span = (row["low"], (row["high"] - row["low"]) * (1 + 1e-9) + 1e-15)
            open_[rank] = ([*path[:-1], (*path[-1], row["bin"]), span], inner)

    for rank in set(ranks):
        row, inner = locate(first, rank)
        step = WHOLE[1] / BINS
        open_[rank] = ([(*WHOLE, row["bin"]), (WHOLE[0] + row["bin"] * step, step)], inner)
    while open_:
        todo = sorted(open_)
        # ranks of one bin share its range
        paths = list(dict.fromkeys(tuple(open_[r][0]) for r in todo))
        inner_of = {r: (paths.index(tuple(open_[r][0])), open_[r][1]) for r in todo}
        open_.clear()
        rows = _narrowed(vectors, paths, block_rows).orderBy("range", "bin").collect()
        for rank, (i, inner) in inner_of.items():
            settle(rank, list(paths[i]), *locate([r for r in rows if r["range"] == i], inner))
    return n, mean_sum / n, top, {r: found[r] for r in ranks}


def similarity_calibration(rows: DataFrame, order: str, vector: str = "embedding", percentiles=(50, 75, 90, 95, 99), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """
    Percentiles (linear interpolation), mean and maximum of the cosine of every pair of the
    rows given: (stat, value). Pairs are counted inside the tasks; the driver sees bin counts.
    """
    vectors = rows.select(F.col(order).cast("bigint").alias("_ord"), F.col(vector).alias("_vec"))
    n_rows = vectors.count()
    n = n_rows * (n_rows - 1) // 2
    spark = rows.sparkSession
    if n == 0:
        return spark.createDataFrame([], "stat string, value double")
    places = {p: (n - 1) * p / 100 for p in percentiles}
    ranks = sorted({int(x) for x in places.values()} | {min(int(x) + 1, n - 1) for x in places.values()})
    _, mean, top, at = _order_statistics(vectors, ranks, block_rows)
    out = [(f"p{p}", at[int(x)] + (at[min(int(x) + 1, n - 1)] - at[int(x)]) * (x - int(x))) for p, x in places.items()]
    return spark.createDataFrame([(s, float(v)) for s, v in [*out, ("mean", mean), ("max", top)]], "stat string, value double")
