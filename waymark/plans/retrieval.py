"""Lexical and dense retrieval, fusion, pooling and routing over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import dedup, dense, fusion, lexical, routing
from waymark.plans.registry import query, spread_table, table
from waymark.plans.roles import role

K = 25

# --- dense ----------------------------------------------------------------------------------

# every indexed utterance is also asked as a request and must be answered by the others
KNN_SQL = """
    SELECT request_id, row_uid, u_id, t_id, query, similarity, CAST(row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, row_uid) AS INT) AS rank
    FROM (SELECT q.row_uid AS request_id, v.row_uid AS row_uid, v.u_id, v.t_id, v.query,
                 round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS similarity
          FROM {vectors} q JOIN {vectors} v ON q.u_id = v.u_id AND q.row_uid <> v.row_uid)
    QUALIFY rank <= 25"""


def vector_rows(spark, sf_dir):
    return role(spark, sf_dir, "vectors")


def requests_of(rows):
    return rows.select(F.col("row_uid").alias("request_id"), "u_id", "embedding")


def neighbours(spark, sf_dir, **kw):
    rows = vector_rows(spark, sf_dir)
    return dense.dense_knn(requests_of(rows), rows, K, scope=["u_id"], skip_self=True, **kw)


@query("dense_knn", f"SELECT request_id, row_uid, u_id, round(similarity, 6) AS similarity, rank FROM ({KNN_SQL})")
def _(spark, sf_dir):
    return neighbours(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query("dense_knn_grid", f"SELECT request_id, row_uid, u_id, round(similarity, 6) AS similarity, rank FROM ({KNN_SQL})")
def _(spark, sf_dir):
    return neighbours(spark, sf_dir, layout="grid").withColumn("similarity", F.round("similarity", 6))


@query("search_dataset", """
    SELECT request_id, row_uid, dataset_id, round(similarity, 6) AS similarity, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, row_uid) AS INT) AS rank FROM (
        SELECT q.row_uid AS request_id, v.row_uid, v.dataset_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS similarity
        FROM {vectors} q JOIN {vectors} v ON q.u_id = v.u_id AND q.dataset_id = v.dataset_id
        WHERE v.row_uid IN (SELECT doc_id FROM {labels} WHERE quality = 1))) WHERE rank <= 5""")
def _(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    good = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_uid"), F.when(F.col("quality") == 1, "valid").otherwise("edge").alias("scenario_type"))
    requests = rows.select(F.col("row_uid").alias("request_id"), "u_id", "dataset_id", "embedding")
    found = dense.search_dataset(requests, rows.join(good, "row_uid"), 5, scenario="valid")
    return found.withColumn("similarity", F.round("similarity", 6)).drop("u_id")


@query("l2_normalise", """
    SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS length, round(e[1] / n, 6) AS first_value, round(e[64] / n, 6) AS last_value
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-9) AS n FROM {embeddings})""")
def _(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", dense.l2_normalise(F.col("embedding")).alias("u"))
    return unit.select(
        "vec_id", F.round(dense.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first_value"), F.round(F.col("u")[63], 6).alias("last_value")
    )


def letter_shares(texts):
    """A small embedding used to exercise caller-supplied functions: share of each letter."""
    import numpy as np

    out = []
    for text in texts:
        counts = np.array([text.lower().count(chr(c)) for c in range(97, 123)], dtype=float)
        out.append((counts / max(counts.sum(), 1.0)).tolist())
    return out


@query("embed_column", """
    SELECT item_id, 26 AS dimension, round(CAST((length(low) - length(replace(low, 'e', ''))) AS DOUBLE) / greatest(length(regexp_replace(low, '[^a-z]', '', 'g')), 1), 6) AS share_e
    FROM (SELECT item_id, lower(text) AS low FROM {benchmark})""")
def _(spark, sf_dir):
    out = dense.embed_column(table(spark, sf_dir, "benchmark"), "text", letter_shares, batch_size=16)
    return out.select("item_id", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[4].cast("double"), 6).alias("share_e"))


# --- lexical --------------------------------------------------------------------------------

_TOKENS = """SELECT {key}, w AS term FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {src})
        UNION ALL SELECT {key}, r FROM (SELECT {key}, unnest(regexp_extract_all(w, '[a-z]+|[0-9]+')) AS r
          FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {src})
          WHERE regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')) WHERE length(r) > 1"""


def tokens_sql(key: str, src: str) -> str:
    return _TOKENS.format(key=key, src="{{" + src + "}}").replace("{{", "{").replace("}}", "}")


POSTINGS_SQL = f"SELECT doc_id, term, count(*) AS tf FROM ({tokens_sql('doc_id', 'documents')}) GROUP BY ALL"
TERMS_SQL = f"""SELECT term, df, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (
        SELECT term, count(*) AS df, (SELECT count(*) FROM {{documents}})::DOUBLE AS n FROM ({POSTINGS_SQL}) GROUP BY term)"""
BM25_SQL = f"""
    WITH p AS MATERIALIZED ({POSTINGS_SQL}), t AS MATERIALIZED ({TERMS_SQL}),
    d AS (SELECT doc_id, sum(tf)::DOUBLE AS doc_len FROM p GROUP BY doc_id),
    a AS (SELECT sum(doc_len) / (SELECT count(*) FROM {{documents}}) AS avgdl FROM d),
    q AS (SELECT item_id AS request_id, term, count(*) AS qtf FROM ({tokens_sql('item_id', 'benchmark')}) GROUP BY ALL),
    s AS (SELECT q.request_id, p.doc_id, round(sum(q.qtf * t.idf * (p.tf * 2.5) / (p.tf + 1.5 * (1.0 - 0.75 + 0.75 * d.doc_len / a.avgdl) + 1e-9)), 9) AS bm25_score
          FROM q JOIN t ON q.term = t.term JOIN p ON p.term = q.term JOIN d ON d.doc_id = p.doc_id, a GROUP BY ALL)
    SELECT request_id, doc_id, bm25_score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY bm25_score DESC, doc_id) AS INT) AS rank
    FROM s WHERE bm25_score > 0 QUALIFY rank <= 25"""


@query("bm25_postings", POSTINGS_SQL)
def _(spark, sf_dir):
    return lexical.bm25_postings(spread_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("bm25_terms", f"SELECT term, df, round(idf, 6) AS idf FROM ({TERMS_SQL})")
def _(spark, sf_dir):
    return lexical.bm25_terms(spread_table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


@query("bm25_docs", f"SELECT doc_id, coalesce(n, 0) AS doc_len FROM {{documents}} LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({tokens_sql('doc_id', 'documents')}) GROUP BY 1) USING (doc_id)")
def _(spark, sf_dir):
    return lexical.bm25_docs(spread_table(spark, sf_dir, "documents"), "doc_id", "text")


def lexical_hits(spark, sf_dir, **kw):
    asked = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "request_id")
    return lexical.bm25_search(asked, spread_table(spark, sf_dir, "documents"), K, **kw)


@query("bm25_search", f"SELECT request_id, doc_id, round(bm25_score, 6) AS bm25_score, rank FROM ({BM25_SQL})")
def _(spark, sf_dir):
    return lexical_hits(spark, sf_dir).withColumn("bm25_score", F.round("bm25_score", 6))


def _grams_sql(key: str, src: str) -> str:
    return f"""SELECT {key}, z[1] || z[2] || z[3] AS gram FROM (
        SELECT {key}, unnest(list_zip(c, c[2:], c[3:], true)) AS z FROM (
          SELECT {key}, string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{{{L}}}}\\p{{{{N}}}}]', ' ', 'g'), ' ') || ' ', '') AS c FROM {{{src}}}))"""


TFIDF_SQL = f"""
    WITH g AS MATERIALIZED (SELECT doc_id, gram, count(*) AS tf FROM ({_grams_sql('doc_id', 'documents')}) GROUP BY ALL),
    i AS MATERIALIZED (SELECT gram, ln((1 + (SELECT count(*) FROM {{documents}})) / (1.0 + count(*))) + 1.0 AS idf FROM g GROUP BY gram),
    w AS MATERIALIZED (SELECT doc_id, gram, tf * idf AS w FROM g JOIN i USING (gram)),
    n AS MATERIALIZED (SELECT doc_id, greatest(sqrt(sum(w * w)), 1e-9) AS norm, count(*) AS n_grams FROM w GROUP BY doc_id)"""


@query("char_tfidf", f"{TFIDF_SQL} SELECT doc_id, round(norm, 6) AS norm, n_grams, round(max(w / norm), 6) AS top_weight FROM w JOIN n USING (doc_id) GROUP BY ALL")
def _(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents")
    vecs = lexical.char_tfidf(docs, "doc_id", "text", lexical.char_idf(docs, "text"))
    return vecs.select(
        "doc_id", F.round("norm", 6).alias("norm"), F.size("terms").cast("bigint").alias("n_grams"), F.round(F.array_max("weights"), 6).alias("top_weight")
    )


@query("sparse_cosine_search", f"""{TFIDF_SQL},
    qg AS (SELECT item_id AS request_id, gram, count(*) * any_value(idf) AS w FROM ({_grams_sql('item_id', 'benchmark')}) JOIN i USING (gram) GROUP BY ALL),
    qn AS (SELECT request_id, greatest(sqrt(sum(w * w)), 1e-9) AS norm FROM qg GROUP BY 1),
    s AS (SELECT qg.request_id, w.doc_id, round(sum((qg.w / qn.norm) * (w.w / n.norm)), 9) AS similarity
          FROM qg JOIN qn USING (request_id) JOIN w ON w.gram = qg.gram JOIN n ON n.doc_id = w.doc_id GROUP BY ALL)
    SELECT request_id, doc_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, doc_id) AS INT) AS rank
    FROM s QUALIFY rank <= 25""")
def _(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "request_id")
    # both sides look grams up in it, in separate jobs
    idf = lexical.char_idf(docs, "text").persist()
    found = lexical.sparse_cosine_search(
        lexical.char_tfidf(asked, "request_id", "text", idf), lexical.char_tfidf(docs, "doc_id", "text", idf), K
    )
    return found.withColumn("similarity", F.round("similarity", 6))


# --- ranking ---------------------------------------------------------------------------------

@query("top_k_per_query", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate) AS INT) AS rank FROM {lineitem}) WHERE rank <= 25""")
def _(spark, sf_dir):
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("item_id", item)
    out = routing.top_k_per_query(rows, K, "l_suppkey", "l_extendedprice")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


def _pool_sql(pooled: str) -> str:
    return f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY request_id, t_id ORDER BY similarity DESC, row_uid) AS pos FROM ({KNN_SQL})),
    p AS (SELECT request_id, t_id, round({pooled}, 9) AS pooled_score, max(similarity) AS vector_score, count(*) AS match_count,
                 max(CASE WHEN pos = 1 THEN substr(query, 1, 200) END) AS best_utterance FROM r GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pooled_score DESC, t_id) AS INT) AS rank FROM p QUALIFY rank <= 5"""


_POOLS = {"max": "max(similarity)", "mean": "sum(CAST(similarity AS DECIMAL(38,9)))::DOUBLE / count(similarity)", "top2mean": "avg(similarity) FILTER (pos <= 2)"}


def candidate_rows(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    found = neighbours(spark, sf_dir)
    return found.join(rows.select("row_uid", "t_id", "query"), "row_uid")


def _pool_query(strategy: str):
    cols = "request_id, t_id, round(pooled_score, 6) AS pooled_score, round(vector_score, 6) AS vector_score, match_count, best_utterance, rank"

    @query(f"pool_to_template_{strategy}", f"SELECT {cols} FROM ({_pool_sql(_POOLS[strategy])})")
    def _(spark, sf_dir):
        out = routing.pool_to_template(candidate_rows(spark, sf_dir), strategy)
        return out.withColumns({"pooled_score": F.round("pooled_score", 6), "vector_score": F.round("vector_score", 6)})


for _strategy in _POOLS:
    _pool_query(_strategy)


@query("alternatives", f"SELECT request_id, t_id, rank FROM ({_pool_sql(_POOLS['max'])}) WHERE rank BETWEEN 2 AND 4")
def _(spark, sf_dir):
    return routing.alternatives(routing.pool_to_template(candidate_rows(spark, sf_dir))).select("request_id", "t_id", "rank")


# --- fusion ------------------------------------------------------------------------------------

# indexed utterances asked of each other lexically, inside the whole collection
DOCS_OF_VECTORS = "SELECT row_uid AS doc_id, query AS text FROM {vectors}"


def _ranked_arms(spark, sf_dir):
    """Two orders of each user's events: by value and by time."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", "event_type")
    by_value = W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    by_time = W.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    first = events.withColumn("rank", F.row_number().over(by_value)).filter("rank <= 50")
    second = events.withColumn("rank", F.row_number().over(by_time)).filter("rank <= 50")
    return first, second


_ARMS = """
    a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, 0 AS arm FROM {events} QUALIFY r <= 50),
    b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r, 1 AS arm FROM {events} QUALIFY r <= 50),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query("rrf", f"""
    WITH {_ARMS},
    f AS (SELECT user_id, event_id, round(sum((CASE arm WHEN 0 THEN 2.0 ELSE 0.5 END)::DOUBLE / (60 + r)), 12) AS score, min(arm * 1000 + r) AS first FROM u GROUP BY ALL)
    SELECT user_id, event_id, round(score, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, first) AS INT) AS rank FROM f QUALIFY rank <= 20""")
def _(spark, sf_dir):
    out = fusion.rrf(_ranked_arms(spark, sf_dir), "user_id", "event_id", weights=[2.0, 0.5], top_k=20)
    return out.withColumn("rrf_score", F.round("rrf_score", 6))


@query("fuse_rows", f"""
    WITH {_ARMS},
    f AS (SELECT user_id, event_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, min(arm * 1000 + r) AS first, any_value(event_type) AS event_type,
                 string_agg(CASE arm WHEN 0 THEN 'vector' ELSE 'lexical' END, ',' ORDER BY arm) AS fusion_sources FROM u WHERE event_type <> 'view' GROUP BY ALL)
    SELECT user_id, event_id, event_type, fusion_sources, round(score, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, first) AS INT) AS rank FROM f QUALIFY rank <= 25""")
def _(spark, sf_dir):
    # a view has no id and is skipped
    arms = [a.withColumn("event_id", F.when(F.col("event_type") != "view", F.col("event_id"))) for a in _ranked_arms(spark, sf_dir)]
    out = fusion.fuse_rows(*arms, "user_id", "event_id", payload=["event_type"], top_k=K)
    return out.select("user_id", "event_id", "event_type", F.array_join("fusion_sources", ",").alias("fusion_sources"), F.round("rrf_score", 6).alias("rrf_score"), "rank")


# --- routing -------------------------------------------------------------------------------------

# Requests of some sources are in trouble: unknown tenant, other model, wrong width, or they name a host.
_REQUESTS = """
    SELECT v.row_uid AS request_id, CASE v.dataset_id WHEN 'src3' THEN 'nobody' ELSE v.u_id END AS u_id,
           CASE v.dataset_id WHEN 'src4' THEN 'other' ELSE 'acme' END AS embedding_model, 64 AS dimension,
           CASE v.dataset_id WHEN 'src6' THEN 'open Shop.Example.com/Cart now' ELSE '' END AS text, v.embedding, v.dataset_id
    FROM {vectors} v"""
_CATALOG = """
    SELECT d.lang AS u_id, CAST(e.label AS BIGINT) AS t_id, CONCAT('api_', CAST(e.label AS STRING)) AS api_name,
           CASE WHEN e.label = 2 THEN NULL ELSE CONCAT('/v1/', d.lang, '/', CAST(e.label AS STRING)) END AS endpoint, CONCAT('/old/', CAST(e.label AS STRING)) AS legacy_field,
           'POST' AS method, 'https://api.example.org' AS base_url
    FROM {embeddings} e JOIN {documents} d ON e.vec_id = d.doc_id WHERE e.label <> 9 GROUP BY d.lang, e.label"""

ROUTE_SQL = f"""
    WITH q AS ({_REQUESTS}), c AS ({_CATALOG}),
    n AS (SELECT q.request_id, v.row_uid, v.t_id, v.query, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS sim
          FROM q JOIN {{vectors}} v ON q.u_id = v.u_id AND q.embedding_model = 'acme' AND q.request_id <> v.row_uid WHERE q.dataset_id <> 'src5'
          QUALIFY row_number() OVER (PARTITION BY q.request_id ORDER BY sim DESC, v.row_uid) <= 25),
    p AS (SELECT request_id, t_id, max(sim) AS score, count(*) AS match_count, arg_max(substr(query, 1, 200), sim * 1e9 - row_uid * 1e-3) AS best_utterance FROM n GROUP BY ALL),
    w AS (SELECT *, sum(match_count) OVER (PARTITION BY request_id) AS total FROM p QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, t_id) = 1),
    r AS (SELECT q.request_id, q.u_id, q.dataset_id, q.text, w.t_id, c.api_name, coalesce(c.endpoint, c.legacy_field) AS endpoint, c.method, w.score, w.match_count, w.total, w.best_utterance,
          CASE WHEN q.dataset_id = 'src5' THEN 'DIMENSION_MISMATCH' WHEN w.t_id IS NULL AND q.u_id = 'nobody' THEN 'NO_RESULTS' WHEN w.t_id IS NULL THEN 'MODEL_MISMATCH'
               WHEN c.t_id IS NULL THEN 'TEMPLATE_NOT_FOUND' END AS error
          FROM q LEFT JOIN w USING (request_id) LEFT JOIN c ON c.u_id = q.u_id AND c.t_id = w.t_id)
    SELECT request_id, u_id, error IS NULL AS success, error, t_id, api_name, endpoint, method, round(score, 4) AS confidence, round(score, 4) AS vector_score,
           match_count, CAST(total AS BIGINT) AS total_candidates, best_utterance,
           CASE WHEN error IS NULL THEN CASE dataset_id WHEN 'src6' THEN 'https://shop.example.com/Cart' ELSE 'https://api.example.org' END END AS effective_base_url,
           CASE WHEN error IS NULL THEN CASE dataset_id WHEN 'src6' THEN 'query' ELSE 'template' END END AS url_source
    FROM r"""


@query("route", ROUTE_SQL)
def _(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    index = rows.withColumns({"embedding_model": F.lit("acme"), "dimension": F.lit(64)})
    asked = spark.sql(_REQUESTS, vectors=rows)
    short = F.when(F.col("dataset_id") == "src5", F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    asked = asked.withColumn("embedding", short)
    known = spark.sql(_CATALOG, embeddings=table(spark, sf_dir, "embeddings"), documents=table(spark, sf_dir, "documents"))
    return routing.route(asked, index, known, K, scope=["u_id", "embedding_model", "dimension"], skip_self=True)


_HEURISTIC = """
    WITH r AS (SELECT k.*, CASE WHEN t_id < 5 THEN 'action' ELSE 'info' END AS intent_type, 0.5 + t_id / 20.0 AS conf FROM ({knn}) k),
    i AS (SELECT doc_id, CASE WHEN {action} > 0 THEN 'action' WHEN {info} > 0 THEN 'info' ELSE 'action' END AS intent FROM (SELECT doc_id, lower(text) AS low FROM documents)),
    m AS (SELECT request_id, t_id, avg(similarity) AS s, avg(conf) AS c, avg(CASE WHEN intent_type = intent THEN 1.0 ELSE 0.0 END) AS a FROM r JOIN i ON i.doc_id = r.request_id GROUP BY ALL),
    z AS (SELECT request_id, t_id, round(CASE WHEN s >= 0.85 THEN least((0.7 * s + 0.15 * c + 0.15 * a) * 1.1, 1.0) ELSE 0.7 * s + 0.15 * c + 0.15 * a END, 9)::DOUBLE AS score FROM m)
    SELECT request_id, t_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, t_id) AS INT) AS rank FROM z"""


def any_of(words):
    return "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words) + ")"


HEURISTIC_SQL = _HEURISTIC.format(knn=KNN_SQL, action=any_of(routing.ACTION_WORDS), info=any_of(routing.INFO_WORDS))


def heuristic_rows(spark, sf_dir):
    rows = candidate_rows(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("request_text"))
    return rows.join(texts, "request_id").withColumns({
        "intent_type": F.when(F.col("t_id") < 5, "action").otherwise("info"), "confidence_score": 0.5 + F.col("t_id") / 20,
    })


@query("weighted_heuristic_rank", HEURISTIC_SQL)
def _(spark, sf_dir):
    return routing.weighted_heuristic_rank(heuristic_rows(spark, sf_dir)).withColumn("score", F.round("score", 6))


# model scores as data: logits for requests in English, probabilities otherwise, none for German, some rows skipped
_SCORES = """SELECT request_id, row_uid, CASE WHEN u_id = 'en' THEN similarity * 8 - 2 ELSE abs(similarity) END AS raw_score
        FROM {hits} WHERE u_id <> 'de' AND t_id <> 7"""


@query("apply_rerank_scores", f"""
    WITH h AS MATERIALIZED ({KNN_SQL}), s AS ({_SCORES.format(hits='h')}),
    j AS (SELECT h.*, raw_score, max(raw_score < 0 OR raw_score > 1) OVER (PARTITION BY h.request_id) AS lg, count(raw_score) OVER (PARTITION BY h.request_id) AS n FROM h LEFT JOIN s USING (request_id, row_uid))
    SELECT request_id, row_uid, round(CASE WHEN n = 0 THEN similarity WHEN raw_score IS NULL THEN 0.0 WHEN lg THEN 1 / (1 + exp(-raw_score)) ELSE raw_score END, 6) AS ce_score,
           raw_score IS NOT NULL AS ce_scored, CASE WHEN n = 0 THEN 'vector_maxpool_fallback' ELSE 'cross_encoder' END AS strategy FROM j""")
def _(spark, sf_dir):
    rows = candidate_rows(spark, sf_dir).select("request_id", "row_uid", "u_id", "t_id", "similarity")
    scores = spark.sql(_SCORES, hits=rows)
    out = routing.apply_rerank_scores(rows, scores)
    return out.select("request_id", "row_uid", F.round("ce_score", 6).alias("ce_score"), "ce_scored", "strategy")


# --- near-duplicates -----------------------------------------------------------------------------

# the vectors given are spread out, so the threshold that drops about half of them is low
THRESHOLD = 0.2

DEDUP_SQL = """
    WITH RECURSIVE o AS MATERIALIZED (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM {embeddings}),
    g AS (SELECT label, n, vec_id, TRUE AS kept, [e] AS acc FROM o WHERE n = 1
          UNION ALL
          SELECT o.label, o.n, o.vec_id, len(list_filter(g.acc, lambda a: list_cosine_similarity(a, o.e) >= 0.2)) = 0,
                 CASE WHEN len(list_filter(g.acc, lambda a: list_cosine_similarity(a, o.e) >= 0.2)) = 0 THEN list_append(g.acc, o.e) ELSE g.acc END
          FROM g JOIN o ON o.label = g.label AND o.n = g.n + 1)"""


def deduped(spark, sf_dir, **kw):
    return dedup.semantic_dedup(table(spark, sf_dir, "embeddings"), "vec_id", bucket=("label",), threshold=THRESHOLD, **kw)


@query("semantic_dedup", f"{DEDUP_SQL} SELECT label, vec_id, kept FROM g")
def _(spark, sf_dir):
    return deduped(spark, sf_dir).select("label", "vec_id", "kept")


@query("semantic_dedup_rounds", f"{DEDUP_SQL} SELECT label, vec_id, kept FROM g")
def _(spark, sf_dir):
    # blocks far smaller than a bucket, so the parallel rounds do the work
    return deduped(spark, sf_dir, block_rows=16).select("label", "vec_id", "kept")


@query("dedup_report", f"""{DEDUP_SQL}
    SELECT count(*) AS total_seen, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, count(DISTINCT label) AS buckets,
           round(count(*) FILTER (NOT kept) / count(*), 4) AS dedup_rate,
           CASE WHEN count(*) FILTER (NOT kept) / count(*) > 0.45 THEN 'very high' WHEN count(*) FILTER (NOT kept) / count(*) < 0.02 AND count(*) > 100 THEN 'suspiciously low' END AS warning
    FROM g""")
def _(spark, sf_dir):
    return dedup.dedup_report(deduped(spark, sf_dir), ("label",))


@query("dedup_buckets", f"{DEDUP_SQL} SELECT label, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM g GROUP BY label")
def _(spark, sf_dir):
    return dedup.bucket_report(deduped(spark, sf_dir), ("label",))


@query("dedup_examples", f"""{DEDUP_SQL},
    lost AS (SELECT g.label, g.vec_id, o.e FROM g JOIN o USING (label, vec_id) WHERE NOT kept ORDER BY vec_id LIMIT 5)
    SELECT lost.vec_id AS dropped_id, o.vec_id AS kept_id, round(list_cosine_similarity(o.e, lost.e), 4) AS similarity
    FROM lost JOIN g ON g.label = lost.label AND g.kept AND g.vec_id < lost.vec_id JOIN o ON o.label = g.label AND o.vec_id = g.vec_id
    QUALIFY row_number() OVER (PARTITION BY lost.vec_id ORDER BY round(list_cosine_similarity(o.e, lost.e), 9) DESC, o.vec_id) = 1""")
def _(spark, sf_dir):
    rows = deduped(spark, sf_dir).withColumn("query", F.col("vec_id").cast("string"))
    return dedup.dropped_examples(rows, "vec_id", bucket=("label",)).select("dropped_id", "kept_id", "similarity")


@query("similarity_calibration", """
    WITH s AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS v FROM {embeddings} a JOIN {embeddings} b ON a.vec_id < b.vec_id)
    SELECT unnest(['p50', 'p75', 'p90', 'p95', 'p99', 'mean', 'max']) AS stat,
           unnest([round(quantile_cont(v, 0.5), 6), round(quantile_cont(v, 0.75), 6), round(quantile_cont(v, 0.9), 6), round(quantile_cont(v, 0.95), 6),
                   round(quantile_cont(v, 0.99), 6), round(avg(v), 6), round(max(v), 6)]) AS value FROM s""")
def _(spark, sf_dir):
    out = dedup.similarity_calibration(table(spark, sf_dir, "embeddings"), "vec_id")
    return out.withColumn("value", F.round("value", 6))
