"""Retrieval, fusion, pooling and near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import blocks, dedup, dense, fusion, lexical, routing


def vectors(spark, n, dim=8, keys=2, seed=3, clusters=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(clusters or n, dim))
    data = base[rng.integers(0, len(base), n)] + (rng.normal(size=(n, dim)) * 0.05 if clusters else 0)
    rows = [(i, f"k{i % keys}", [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    return rows, spark.createDataFrame(rows, "row_uid bigint, u_id string, embedding array<float>")


def unit(rows):
    m = np.array([r[2] for r in rows])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_knn_layouts_agree_with_brute_force(spark):
    rows, df = vectors(spark, 300)
    sims = np.round(unit(rows) @ unit(rows).T, 9)
    want = {}
    for i, (_, key, _) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i and rows[j][1] == key]
        want[i] = sorted(others, key=lambda j: (-sims[i, j], j))[:7]
    asked = df.withColumnRenamed("row_uid", "request_id")
    for kw in ({"layout": "travel"}, {"layout": "grid", "block_rows": 40}):
        got = {}
        for r in dense.dense_knn(asked, df, 7, scope=["u_id"], skip_self=True, **kw).orderBy("request_id", "rank").collect():
            got.setdefault(r["request_id"], []).append(r["row_uid"])
        assert got == want


def test_knn_ties_and_tenants(spark):
    # a third of the vectors are copies, and one request has no tenant
    items = spark.createDataFrame([(i, "a" if i else None, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(60)], "row_uid bigint, u_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "b", [1.0, 0.0])], "request_id bigint, u_id string, embedding array<float>")
    for layout in ("travel", "grid"):
        got = dense.dense_knn(asked, items, 3, scope=["u_id"], layout=layout, block_rows=10).orderBy("rank").collect()
        assert [(r["request_id"], r["row_uid"]) for r in got] == [(1, 1), (1, 2), (1, 4)]


def test_knn_rejects_other_widths(spark):
    items = spark.createDataFrame([(1, "a", [1.0, 0.0])], "row_uid bigint, u_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "a", [1.0])], "request_id bigint, u_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        dense.dense_knn(asked, items, 1, scope=["u_id"]).collect()


def test_bm25_prefers_the_rare_word_and_layouts_agree(spark):
    docs = spark.createDataFrame(
        [(0, "cancel my order"), (1, "list every order order"), (2, "refund pay331 today"), (3, "weather")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "refund order"), (2, "PAY 331"), (3, "nothing shared")], "request_id bigint, text string")
    results = []
    for kw in ({"layout": "travel"}, {"layout": "grid", "block_rows": 2}):
        rows = lexical.bm25_search(asked, docs, 2, **kw).orderBy("request_id", "rank").collect()
        results.append([(r["request_id"], r["doc_id"], round(r["bm25_score"], 6)) for r in rows])
    assert results[0] == results[1]
    assert results[0][0][:2] == (1, 2) and results[0][2][:2] == (2, 2) and {r[0] for r in results[0]} == {1, 2}


def test_sparse_scorer_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 5} common text number {i}") for i in range(40)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "common word3 text")], "request_id bigint, text string")
    whole = lexical.bm25_search(asked, docs, 40, layout="grid").count()
    assert whole == 40
    assert lexical.bm25_search(asked, docs, 40, layout="grid", block_rows=7).count() == 40


def test_rrf(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, i string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, i string, rank int")
    got = [(r["i"], round(r["rrf_score"], 6)) for r in fusion.rrf([a, b], "q", "i").orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]
    with pytest.raises(ValueError, match="weights"):
        fusion.rrf([a, b], "q", "i", weights=[1.0])


def test_pooling(spark):
    rows = spark.createDataFrame(
        [(1, 10, 7, "best", 0.9), (1, 11, 7, "bad", 0.1), (1, 12, 8, "even", 0.6), (1, 13, 8, "even", 0.6), (1, 14, None, "lost", 1.0)],
        "request_id int, row_uid int, t_id int, query string, similarity double")
    top = {s: routing.pool_to_template(rows, s).filter("rank = 1").first()["t_id"] for s in routing.STRATEGIES}
    assert top == {"max": 7, "mean": 8, "top2mean": 8}
    best = routing.pool_to_template(rows).filter("rank = 1").first()
    assert (best["best_utterance"], best["match_count"]) == ("best", 2)
    with pytest.raises(ValueError):
        routing.pool_to_template(rows, "median")


def test_rerank_scores(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.3)], "request_id int, row_uid int, similarity double")
    scores = spark.createDataFrame([(1, 1, 2.0)], "request_id int, row_uid int, raw_score double")
    got = {(r["request_id"], r["row_uid"]): (round(r["ce_score"], 4), r["strategy"]) for r in routing.apply_rerank_scores(rows, scores).collect()}
    assert got == {(1, 1): (0.8808, "cross_encoder"), (1, 2): (0.0, "cross_encoder"), (2, 1): (0.3, "vector_maxpool_fallback")}


def greedy(rows, threshold):
    kept, accepted = [], {}
    for i, key, vec in rows:
        v = np.array(vec)
        v = v / max(np.linalg.norm(v), 1e-9)
        if all(a @ v < threshold for a in accepted.get(key, [])):
            accepted.setdefault(key, []).append(v)
            kept.append(i)
    return kept


@pytest.mark.parametrize("block_rows", [8_192, 25])
def test_dedup_equals_the_sequential_rule(spark, block_rows):
    rows, _ = vectors(spark, 240, keys=3, clusters=25)
    # a hot bucket: a third of all rows are exact copies, and there are zero vectors
    rows += [(1000 + i, "k0", rows[0][2]) for i in range(120)] + [(2000 + i, "k0", [0.0] * 8) for i in range(3)]
    df = spark.createDataFrame(rows, "row_uid bigint, u_id string, embedding array<float>").repartition(5)
    out = dedup.semantic_dedup(df, "row_uid", bucket=("u_id",), threshold=0.92, block_rows=block_rows)
    assert sorted(r["row_uid"] for r in out.filter("kept").collect()) == greedy(rows, 0.92)
    assert out.count() == len(rows)


def test_dedup_chain_is_order_dependent(spark):
    # each is near the next, the ends are not: first and third stay
    angles = [0.0, 0.3, 0.6]
    rows = [(i, "a", [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angles)]
    df = spark.createDataFrame(rows, "row_uid bigint, u_id string, embedding array<float>")
    for block_rows in (10, 1):
        kept = dedup.semantic_dedup(df, "row_uid", bucket=("u_id",), threshold=0.95, block_rows=block_rows).filter("kept").collect()
        assert sorted(r["row_uid"] for r in kept) == [0, 2]


@pytest.mark.parametrize("block_rows", [8_192, 20])
def test_calibration(spark, block_rows):
    rows, df = vectors(spark, 90)
    sims = (unit(rows) @ unit(rows).T)[np.triu_indices(90, 1)]
    got = {r["stat"]: r["value"] for r in dedup.similarity_calibration(df, "row_uid", block_rows=block_rows).collect()}
    for p in (50, 75, 90, 95, 99):
        assert got[f"p{p}"] == pytest.approx(np.percentile(sims, p), abs=1e-9)
    assert got["mean"] == pytest.approx(sims.mean(), abs=1e-9) and got["max"] == pytest.approx(sims.max(), abs=1e-12)


def test_calibration_of_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i < 50 else [0.0, 1.0]) for i in range(60)], "row_uid bigint, embedding array<float>")
    got = {r["stat"]: round(r["value"], 9) for r in dedup.similarity_calibration(df, "row_uid", block_rows=7).collect()}
    assert got["p50"] == 1.0 and got["max"] == 1.0


def test_embedder_must_answer_every_text(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    with pytest.raises(Exception, match="returned 1 vectors for 2"):
        dense.embed_column(df.coalesce(1), "text", lambda texts: [[1.0]]).collect()


def test_best_k_orders_by_score_then_id():
    q, ids, s = np.array([0, 0, 0, 1]), np.array(["b", "a", "c", "z"]), np.array([0.5, 0.5, 0.9, 0.1])
    assert [ids[i] for i in blocks.best_k(q, ids, s, 2)] == ["c", "a", "z"]
