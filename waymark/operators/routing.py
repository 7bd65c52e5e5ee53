"""From scored rows to a template per request: pooling, reranking by given scores, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.intent import phrase_count
from waymark.functions.text import normalised_url
from waymark.operators import dense, templates as catalog
from waymark.session import checkpointed

STAGE2_K = 5
PAIRS, TASK_PAIRS = 1_000_000, 20_000  # pairs whose texts are on their way at once, and of one task about
STRATEGIES = ("max", "mean", "top2mean")
# Words that make a request an action, else information, else an action.
ACTION_WORDS = [
    "create", "make", "add", "submit", "place", "generate", "process", "send", "post", "put", "delete", "update", "modify",
    "change", "set", "login", "logout", "register", "signup", "cancel", "refund", "please", "i want to",
]
INFO_WORDS = ["what", "how", "where", "when", "why", "which", "who", "show me", "list", "check", "did", "is", "has"]
# Weights of the first ranking formula.
SIMILARITY_WEIGHT, CONFIDENCE_WEIGHT, INTENT_WEIGHT = 0.7, 0.15, 0.15
BOOST_FROM, BOOST = 0.85, 1.1


def top_k_per_query(scores: DataFrame, k: int, query: str = "request_id", score: str = "score", item: str = "item_id") -> DataFrame:
    """k best per query, ties by id; the group limit prunes each partition before the shuffle."""
    order = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pool_to_template(
    rows: DataFrame, strategy: str = "max", top_k: int = STAGE2_K, query: Sequence[str] = ("request_id",), score: str = "similarity",
    item: str = "row_uid", attributes: Sequence[str] = ("query",),
) -> DataFrame:
    """
    One row per (request, template) from scored rows: pooled score, best cosine, number of
    matches, attributes of the best row (utterance cut to 200 characters), rank. Rows without
    a template are dropped. Input is the candidates of each request, at most k of them.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    group = [*query, "t_id"]
    best_first = F.struct(F.col(score), -F.col("_pos"))
    order = W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item))
    named = rows.filter(F.col("t_id").isNotNull()).withColumn("_pos", F.row_number().over(order))
    pooled = {
        "max": F.max(score),
        "mean": F.sum(F.col(score).cast("decimal(28,9)")).cast("double") / F.count(score),
        "top2mean": F.avg(F.when(F.col("_pos") <= 2, F.col(score))),
    }[strategy]
    out = named.groupBy(*group).agg(
        pooled.alias("pooled_score"), F.max("similarity").alias("vector_score"), F.count("*").alias("match_count"),
        *[F.max_by(F.substring(a, 1, 200) if a == "query" else F.col(a), best_first).alias("best_utterance" if a == "query" else a) for a in attributes],
    )
    # nine digits of the binary number: a tie of its decimal text is not one of the number
    out = out.withColumn("pooled_score", F.round(F.col("pooled_score") * 1e9) / 1e9)
    rank = W.partitionBy(*query).orderBy(F.col("pooled_score").desc(), F.col("t_id"))
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top_k)


def alternatives(pooled: DataFrame) -> DataFrame:
    """What is shown beside the winner."""
    return pooled.filter(F.col("rank").between(2, 4))


def auto_intent(text: Column) -> Column:
    low = F.trim(F.lower(text))
    return F.when(phrase_count(low, ACTION_WORDS) > 0, "action").when(phrase_count(low, INFO_WORDS) > 0, "info").otherwise("action")


def weighted_heuristic_rank(rows: DataFrame, query: str = "request_id", intent: str | None = None) -> DataFrame:
    """
    Mean similarity, mean confidence and share of rows whose intent is the request's, weighted;
    boosted for a very similar template. Wants similarity, confidence_score, intent_type and request_text,
    or in its place the column ``intent`` with what the text was found to be.
    """
    aligned = (F.col("intent_type") == (F.col(intent) if intent else auto_intent(F.col("request_text")))).cast("double")
    means = rows.groupBy(query, "t_id").agg(
        F.avg("similarity").alias("avg_sim"), F.avg(F.coalesce("confidence_score", F.lit(0.7))).alias("avg_conf"), F.avg(F.coalesce(aligned, F.lit(0.0))).alias("align")
    )
    base = SIMILARITY_WEIGHT * F.col("avg_sim") + CONFIDENCE_WEIGHT * F.col("avg_conf") + INTENT_WEIGHT * F.col("align")
    boosted = F.when(F.col("avg_sim") >= BOOST_FROM, F.least(base * BOOST, F.lit(1.0))).otherwise(base)
    scored = means.select(query, "t_id", F.round(boosted, 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc(), F.col("t_id"))))


def cross_encode(
    pairs: DataFrame, requests: DataFrame, items: DataFrame, model: Callable[[Sequence[str], Sequence[str]], Sequence[float]],
    query: str = "request_id", item: str = "row_uid", text: str = "text", item_text: str = "query", batch_size: int = 256,
) -> DataFrame:
    """
    Raw scores (query, item, raw_score) of a caller-supplied model that reads the texts of each pair, in batches.

    A pair whose item has no text but white space is not scored. Both texts travel with a pair, so pairs are scored in parts
    of about ``PAIRS`` by request, each stored before the next begins.
    """
    schema = f"{query} {pairs.schema[query].dataType.simpleString()}, {item} {pairs.schema[item].dataType.simpleString()}, raw_score double"
    pairs = checkpointed(pairs.select(query, item))
    said = items.filter(F.col(item_text).rlike(r"\S")).select(item, F.col(item_text).alias("_found"))
    asked = requests.select(query, F.coalesce(text, F.lit("")).alias("_asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                scores = model(part.column("_asked").to_pylist(), part.column("_found").to_pylist())
                if len(scores) != part.num_rows:
                    raise ValueError(f"model returned {len(scores)} scores for {part.num_rows} pairs")
                yield pa.RecordBatch.from_arrays([part.column(query), part.column(item), pa.array([float(x) for x in scores], pa.float64())], [query, item, "raw_score"])

    parts = max(1, -(-pairs.count() // PAIRS))
    out = []
    for part in range(parts):
        mine = F.pmod(F.xxhash64(query), F.lit(parts)) == part
        # dealt over a fixed number of tasks: the model's work does not go by the bytes of texts
        tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, PAIRS // TASK_PAIRS if parts > 1 else 0)
        found = pairs.filter(mine).join(said, item).repartition(tasks, query)
        whole = found.join(asked.filter(mine).repartition(tasks, query), query).select(query, item, "_asked", "_found")
        out.append(checkpointed(whole.mapInArrow(run, schema)))
        if part + 1 < parts:
            # Spark removes the files of a shuffle once nothing in the JVM refers to it
            del found, whole
            pairs.sparkSession.sparkContext._jvm.System.gc()
    return reduce(DataFrame.unionByName, out)


def apply_rerank_scores(rows: DataFrame, scores: DataFrame, query: str = "request_id", item: str = "row_uid") -> DataFrame:
    """
    Attach model scores (query, item, raw_score) given as data.

    One raw score outside [0, 1] puts the whole request through the logistic function. Rows the
    model skipped score 0. A request without any score falls back to its cosine, and says so.
    """
    joined = rows.join(scores.select(query, item, "raw_score"), [query, item], "left")
    over = W.partitionBy(query)
    raw = F.col("raw_score")
    logistic = F.coalesce(F.max((raw < 0) | (raw > 1)).over(over), F.lit(False))
    any_score = F.count(raw).over(over) > 0
    sigmoid = 1.0 / (1.0 + F.exp(-raw))
    out = joined.select("*", logistic.alias("_logistic"), any_score.alias("_any"))
    value = F.when(raw.isNull(), 0.0).when(F.col("_logistic"), sigmoid).otherwise(raw)
    return out.withColumns({
        "ce_score": F.when(F.col("_any"), value).otherwise(F.col("similarity")),
        "ce_scored": raw.isNotNull(),
        "strategy": F.when(F.col("_any"), "cross_encoder").otherwise("vector_maxpool_fallback"),
    }).drop("_logistic", "_any", "raw_score")


def route(
    requests: DataFrame, vectors: DataFrame, templates: DataFrame, k: int = dense.STAGE1_K, scope: Sequence[str] = ("u_id", *dense.TRIPLE),
    skip_self: bool = False, layout: str = "auto",
) -> DataFrame:
    """
    Best catalogue entry of every request, one output row per request.

    requests: request_id, u_id, embedding_provider, embedding_model, dimension, text, embedding.
    vectors: row_uid, t_id, query, embedding and the same scope columns.
    templates: u_id, t_id, api_name, endpoint, legacy_field, method, base_url.
    """
    scope = list(scope)
    fits = F.coalesce(F.size("embedding") == F.col("dimension"), F.lit(False))
    found = dense.dense_knn(requests.filter(fits), vectors, k, scope, skip_self=skip_self, layout=layout)
    rows = found.join(vectors.select("row_uid", "t_id", "query"), "row_uid")
    per_request = rows.groupBy("request_id").agg(F.count("*").alias("total_candidates"))
    winner = pool_to_template(rows).filter("rank = 1").select("request_id", "t_id", "pooled_score", "vector_score", "match_count", "best_utterance")

    known = templates.select(
        "u_id", "t_id", F.col("api_name"), F.coalesce("endpoint", "legacy_field").alias("endpoint"), "method", "base_url", F.lit(True).alias("_known")
    )
    # tenants that hold vectors of other models: nothing found then means a model mismatch
    tenants = vectors.select("u_id").distinct().withColumn("_has_vectors", F.lit(True))
    url = normalised_url(F.col("text"))
    out = (
        requests.select("request_id", "u_id", url.alias("extracted_base_url"), fits.alias("_fits"))
        .join(winner, "request_id", "left").join(per_request, "request_id", "left")
        .join(known, ["u_id", "t_id"], "left").join(tenants, "u_id", "left")
    )
    error = (
        F.when(~F.col("_fits"), "DIMENSION_MISMATCH")
        .when(F.col("total_candidates").isNull(), F.when(F.col("_has_vectors"), "MODEL_MISMATCH").otherwise("NO_RESULTS"))
        .when(F.col("t_id").isNull(), "RANKING_FAILED")
        .when(F.col("_known").isNull(), "TEMPLATE_NOT_FOUND")
    )
    return out.select(
        "request_id", "u_id", error.isNull().alias("success"), error.alias("error"), "t_id", "api_name", "endpoint", "method",
        F.round("pooled_score", 4).alias("confidence"), F.round("vector_score", 4).alias("vector_score"), "match_count", "total_candidates",
        "best_utterance",
        F.when(error.isNull(), F.coalesce("extracted_base_url", "base_url")).alias("effective_base_url"),
        F.when(error.isNull(), F.when(F.col("extracted_base_url").isNotNull(), "query").otherwise("template")).alias("url_source"),
    )


def hybrid_search(dense_rows: DataFrame, lexical_rows: DataFrame, k: int = dense.STAGE1_K, query: str = "request_id", item: str = "row_uid") -> DataFrame:
    """
    Fusion of dense and BM25 neighbours. Rows both found keep the cosine, rows only BM25
    found have similarity 0.
    """
    from waymark.operators.fusion import fuse_rows

    lexical = lexical_rows.withColumn("similarity", F.lit(0.0))
    fused = fuse_rows(dense_rows, lexical, query, item, payload=["similarity"], top_k=k)
    return fused


def resolved(pooled: DataFrame, templates: DataFrame) -> DataFrame:
    return catalog.resolve_template(pooled.filter("rank = 1"), templates)
