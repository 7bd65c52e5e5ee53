"""What keeps the work of a task bounded, and results equal to plain ones."""

import numpy as np
import pyarrow as pa

from waymark.operators import blocks, dedup
from waymark.session import spread_rows


def side(vectors, ids):
    return pa.table({"_id": pa.array(ids), "_load": pa.array([v.tolist() for v in vectors])})


def test_sides_are_read_once_and_tiles_are_bounded(monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 7)
    monkeypatch.setattr(blocks, "TILE_ITEMS", 11)
    monkeypatch.setattr(blocks, "FIRST_ITEMS", 5)
    draw = np.random.default_rng(1)
    vectors, ids = draw.normal(size=(60, 4)), [i // 2 for i in range(60)]
    calls, tiles = [], []

    def scorer(requests, items):
        calls.append(1)
        scores_of = blocks.cosine_scorer(requests, items)

        def tile(rows, cols):
            tiles.append((rows.stop - rows.start, cols.stop - cols.start))
            return scores_of(rows, cols)

        return tile

    table = side(vectors, ids)
    q, found, scores = blocks._candidates(table, table, scorer, 3, False, True)
    assert len(calls) == 1 and all(r <= 7 and c <= 11 for r, c in tiles)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    all_scores = np.round(unit @ unit.T, blocks.SCORE_DIGITS)
    for i in range(60):
        others = sorted((-s, j) for s, j in zip(all_scores[i], ids) if j != ids[i])[:3]
        assert [(-s, j) for s, j in zip(scores[q == i], found[q == i])] == others


def test_a_key_of_one_block_is_cut_into_several(spark):
    df = spark.range(5000).selectExpr("'a' AS _key")
    assert blocks.block_count(df, 16_384, "n").first()["n"] == 5


def test_rounds_do_not_copy_rows_into_cells_of_the_last_rest(spark, monkeypatch):
    asked, plain = [], dedup._has_earlier_neighbour
    monkeypatch.setattr(dedup, "_has_earlier_neighbour", lambda r, o, t, rows: asked.append(rows) or plain(r, o, t, rows))
    monkeypatch.setattr(dedup, "TILE", 9)
    vectors = np.random.default_rng(2).normal(size=(60, 3))
    rows = spark.createDataFrame([(i, "b", v.tolist()) for i, v in enumerate(vectors)], "n long, b string, embedding array<double>")
    got = {r["n"] for r in dedup.semantic_dedup(rows, "n", bucket=("b",), threshold=0.9, block_rows=4).filter("kept").collect()}
    unit, kept = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), []
    for i in range(60):
        if all(unit[i] @ unit[j] < 0.9 for j in kept):
            kept.append(i)
    assert got == set(kept) and len(kept) < 60 and min(asked) >= dedup.CELL_ROWS


def test_calibration_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 13)
    vectors = np.random.default_rng(3).normal(size=(90, 5))
    vectors[40:50] = vectors[30:40]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "n long, embedding array<double>")
    got = {r["stat"]: r["value"] for r in dedup.similarity_calibration(rows, "n", block_rows=25).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs = (unit @ unit.T)[np.triu_indices(90, 1)]
    assert np.allclose([got[f"p{p}"] for p in (50, 75, 90, 95, 99)], np.percentile(pairs, [50, 75, 90, 95, 99]), atol=1e-11)
    assert np.allclose([got["mean"], got["max"]], [pairs.mean(), pairs.max()], atol=1e-11)


def test_parts_by_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 1000 * (cores + 3), 1, cores)
    assert spread_rows(df, 1000, "id").rdd.getNumPartitions() == cores + 3
    assert spread_rows(df, 10**9, "id").rdd.getNumPartitions() == cores


def test_cells_keep_a_task_each_however_few_their_bytes(spark):
    rows = spark.range(60).selectExpr("'a' AS _key", "id AS _id", "array(double(id + 1), 1.0) AS _load")
    schema = pa.schema([("_key", pa.string()), ("_q", pa.int64()), ("_item", pa.int64()), ("_score", pa.float64())])
    found = blocks._grid(rows, rows, blocks.cosine_scorer, 3, False, True, 10, schema, "_key string, _q long, _item long, _score double")
    assert found.rdd.getNumPartitions() == blocks.cell_parts(rows, 36) == 72
    assert blocks.cell_parts(rows, 10**9) == max(blocks.LEAST_PARTS, blocks.PARTS_A_CORE * spark.sparkContext.defaultParallelism)
    vectors = rows.selectExpr("_id AS _ord", "_load AS _vec")
    sizes = dedup._in_cells(vectors, 10).applyInArrow(_pairs_of, "n long")
    assert sizes.rdd.getNumPartitions() == 42 and sizes.agg({"n": "sum"}).first()[0] == 60 * 59 // 2


def _pairs_of(key, table):
    return pa.table({"n": [sum(len(x) for x in dedup._tiles(key, table))]})


def test_a_request_side_is_made_once(spark, monkeypatch):
    from waymark.operators import lexical

    made, plain = [], lexical.checkpointed
    monkeypatch.setattr(lexical, "checkpointed", lambda df: made.append(df.columns) or plain(df))
    docs = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "blue hen")], "doc_id long, text string")
    got = lexical.bm25_search(docs.withColumnRenamed("doc_id", "request_id"), docs, 1, skip_self=True, layout="grid").collect()
    assert made == [["request_id", "load"]] and sorted((r["request_id"], r["doc_id"]) for r in got) == [(1, 2), (2, 1), (3, 2)]


def test_tiles_are_looked_through_in_single_precision_and_ranked_in_double(monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 16)
    monkeypatch.setattr(blocks, "TILE_ITEMS", 32)
    monkeypatch.setattr(blocks, "FIRST_ITEMS", 24)
    draw = np.random.default_rng(5)
    vectors = np.repeat(draw.normal(size=(30, 8)), 10, axis=0)
    # neighbours that single precision cannot tell apart, equal ones, one of no length
    vectors += draw.normal(size=vectors.shape) * np.repeat([1e-6, 0.0, 1e-3], 100)[:, None]
    vectors[7] = 0
    whole, scored = [], []
    plain = blocks.Cosine.at
    monkeypatch.setattr(blocks.Cosine, "__call__", lambda self, rows, cols: whole.append(1))
    monkeypatch.setattr(blocks.Cosine, "at", lambda self, rows, cols: scored.append(len(rows)) or plain(self, rows, cols))
    unit = blocks.normalised(vectors)
    want = np.round(unit @ unit.T, blocks.SCORE_DIGITS)
    for ids in (list(range(300)), [f"{i:03}" for i in range(300)]):
        table = side(vectors, ids)
        q, found, scores = blocks._candidates(table, table, blocks.cosine_scorer, 5, False, True)
        for i in range(300):
            best = sorted((-s, j) for s, j in zip(want[i], ids) if j != ids[i])[:5]
            assert [j for _, j in best] == found[q == i].tolist() and np.allclose([-s for s, _ in best], scores[q == i], atol=2e-9)
    assert not whole and sum(scored) < 2 * 300 * 300 * 0.6
    few = side(vectors[:3], [0, 1, 2])
    q, found, _ = blocks._candidates(few, few, blocks.cosine_scorer, 5, False, True)
    assert sorted(zip(q.tolist(), found.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
