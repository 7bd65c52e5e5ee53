"""The routing benchmark: all strategies, a model that reads both texts, every case."""

import pytest

from waymark.operators import routing
from waymark.plans import evaluation
from waymark.plans.registry import QUERIES


def test_a_model_reads_both_texts_of_each_pair(spark, monkeypatch):
    monkeypatch.setattr(routing, "PAIRS", 3)
    texts = {1: "red fox", 2: "red hen", 3: " \t", 4: "blue"}
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a != b], "request_id long, row_uid long")
    items = spark.createDataFrame(list(texts.items()), "row_uid long, query string")
    asked = items.selectExpr("row_uid AS request_id", "query AS text")
    got = {(r[0], r[1]): r[2] for r in routing.cross_encode(pairs, asked, items, lambda a, b: [len(x) * 100 + len(y) for x, y in zip(a, b)], batch_size=2).collect()}
    # an item without words is not scored
    assert got == {(a, b): len(texts[a]) * 100.0 + len(texts[b]) for a in texts for b in texts if a != b and b != 3}
    with pytest.raises(Exception, match="0 scores for 1 pairs"):
        routing.cross_encode(pairs.filter("request_id = 1 AND row_uid = 2"), asked, items, lambda a, b: []).collect()


def test_the_summary_has_every_strategy_and_case(spark, tmp_path):
    rows = [(i, f"word{i % 3} order {i} {'cancel' if i % 2 else 'list'}", ["en", "fr", "de", "es"][i % 4], f"src{i % 3}") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [float(i % 5 + 1), float(i % 3), 1.0], i % 8) for i in range(24)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    # half of the cases have no latency
    spark.range(12).selectExpr("id AS event_id", "double(id) AS value").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["strategy"], r["tier"]): r["n"] for r in QUERIES["routing_summary"](spark, str(tmp_path)).collect()}
    assert got == {(s, t): n for s in evaluation.ALL_STRATEGIES for t, n in (("overall", 24), ("direct", 6), ("paraphrase", 6), ("colloquial", 6), ("hard_negative", 6))}


def test_the_stand_in_for_a_model():
    assert evaluation.shared_words(["red fox", "a b", "", "x"], ["fox RED", "b c", "", ""]) == [6.0, 8 / 3 - 2, -2.0, -2.0]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_texts_without_a_vector_are_not_shuffled(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(evaluation, "MOST_IDS", most)
    documents = [(i, f"text {i}", "en", "src0") for i in [*range(40), 3]] + [(None, "lost", "en", "src0")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, float(i or 0)], 1) for i in (1, 3, 5, 5, 99, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = evaluation.indexed(spark, str(tmp_path))
    assert sorted((r["row_uid"], r["query"]) for r in rows.collect()) == [(1, "text 1"), (3, "text 3"), (3, "text 3"), (5, "text 5"), (5, "text 5")]
    assert ("LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)
