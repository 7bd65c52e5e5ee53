"""Blocks of requests that are held while items pass by, and numbered terms."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.operators import blocks, dense, lexical, terms


def test_items_are_copied_once_a_block_and_requests_once_a_group(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SPREAD_BLOCKS", 2)
    monkeypatch.setattr(blocks, "ITEM_ROWS", 7)
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(150, 4))
    vectors[40:50] = vectors[30:40]
    df = spark.createDataFrame([(i, f"k{i % 2}", v.tolist()) for i, v in enumerate(vectors)], "row_uid long, u_id string, embedding array<double>")
    sides, plain = [], blocks._grid
    monkeypatch.setattr(blocks, "block_count", lambda d, rows, name, bytes_of=None: d.groupBy("_key").agg(F.ceil(F.count("*") / rows).cast("int").alias(name)))
    monkeypatch.setattr(blocks, "_grid", lambda *a: sides.append(plain(*a)) or sides[-1])
    asked = df.withColumnRenamed("row_uid", "request_id")
    # eight blocks of requests a key; groups are two a core at least, and no more than blocks of items
    found = dense.dense_knn(asked, df, 5, scope=["u_id"], skip_self=True, layout="grid", block_rows=10)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, blocks.SCORE_DIGITS)
    got = {}
    for r in found.orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["row_uid"])
    assert got == {i: sorted((j for j in range(150) if j != i and j % 2 == i % 2), key=lambda j: (-scores[i, j], j))[:5] for i in range(150)}
    cores = spark.sparkContext.defaultParallelism
    groups = min(8, max(2, -(-2 * cores // 8)))
    per_cell = sides[0].groupBy("_key", "_q").count().agg(F.max("count")).first()[0]
    assert per_cell <= 5 * groups < 5 * 8


def test_a_cell_may_be_cut_by_batches_anywhere():
    draw = np.random.default_rng(9)
    schema = pa.schema([("_key", pa.string()), ("_q", pa.int64()), ("_item", pa.int64()), ("_score", pa.float64())])
    rows = []
    for cell in range(3):
        rows += [("a", 0, cell, {"q": q, "i": None}, draw.normal(size=3).tolist(), 0) for q in range(4)]
        rows += [("a", 0, cell, {"q": None, "i": i}, draw.normal(size=3).tolist(), 1) for i in range(20)]
    rows += [("b", 0, 0, {"q": None, "i": 1}, [1.0, 0.0, 0.0], 1), ("c", 0, 0, {"q": 1, "i": None}, [1.0, 0.0, 0.0], 0)]
    table = pa.Table.from_pylist([dict(zip(("_key", "_ib", "_qb", "_id", "_load", "_side"), r)) for r in rows])
    seen = set()
    for size in (1, 5, 24, 1000):
        for slice_rows in (3, 100):
            scan = blocks._stream(blocks.cosine_scorer, 2, False, False, slice_rows, schema)
            out = pa.Table.from_batches(list(scan(iter(table.to_batches(max_chunksize=size)))), schema)
            seen.add(tuple(sorted((r["_q"], r["_item"], r["_score"]) for r in out.to_pylist())))
            assert len(out) == 3 * 4 * 2
    assert len(seen) == 1


def test_planes_give_back_what_they_got():
    sizes = np.array([2, 0, 3, 1])
    columns = [np.array([1, 70_000, 5, 300, 2**31 - 1, 0], np.int32), np.array([9, 8, 7, 6, 5, 2**24], np.int32)]
    load = terms.to_planes(np.array([4, 0, 2**30, 1]), sizes, *columns)
    for part, rows, entries in ((load, slice(0, 4), slice(0, 6)), (load.slice(2), slice(2, 4), slice(2, 6))):
        head, row, *got = terms.from_planes(part, 2)
        assert head.tolist() == [4, 0, 2**30, 1][rows] and row.tolist() == np.repeat(np.arange(len(sizes[rows])), sizes[rows]).tolist()
        assert [g.tolist() for g in got] == [c[entries].tolist() for c in columns]
    assert [len(x) for x in terms.from_planes(pa.array([], pa.binary()), 3)] == [0] * 5


@pytest.mark.parametrize("most", [1, 10**6])
def test_many_requests_without_a_row_a_posting(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "SHARD_TOKENS", most)
    monkeypatch.setattr(terms, "BUCKET_WORDS", 3)
    draw = np.random.default_rng(4)
    # no digits: mixed words give more tokens
    words = [f"w{chr(97 + i)}" for i in range(26)]
    texts = [" ".join(draw.choice(words, 8)) for _ in range(40)] + ["", None, "wb wb wb"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "wb wc"), (1, "wc wh"), (2, "wd unheard wd"), (3, "unheard"), (4, None), (None, "wf")], "request_id long, text string")
    plain = [r for r in asked.collect() if r["text"]]
    found = lexical.bm25_search(asked, docs, 6, layout="grid", block_rows=5).orderBy("request_id", "rank").collect()
    # every text that is there counts, and the mean length is over those
    counted = [(i, t.split()) for i, t in enumerate(texts) if t is not None]
    n, mean = len(texts), sum(len(t) for _, t in counted) / len(counted)
    df = {w: sum(w in t for _, t in counted) for w in words}
    for q in (1, 2, None):
        query = " ".join(r["text"] for r in plain if r["request_id"] == q).split()
        want = []
        for i, t in counted:
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean) + 1e-9) for w in query if w in df)
            want += [(-round(s, 9), i)] if s > 0 else []
        got = [(r["doc_id"], round(r["bm25_score"], 6)) for r in found if r["request_id"] == q]
        assert got == [(i, round(-s, 6)) for s, i in sorted(want)[:6]] and len(got) == 6
    assert not [r for r in found if r["request_id"] in (3, 4)]
