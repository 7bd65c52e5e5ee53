"""Usage, latency and histogram aggregates over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import metrics
from waymark.plans.registry import query, table
from waymark.plans.roles import role


@query("vector_stats", """
    SELECT u_id, CAST(NULL AS VARCHAR) AS embedding_provider, CAST(NULL AS VARCHAR) AS embedding_model, CAST(NULL AS INT) AS dimension, count(*) AS n FROM {vectors} GROUP BY 1
    UNION ALL SELECT u_id, 'acme', dataset_id, 64, count(*) FROM {vectors} GROUP BY 1, 3""")
def _(spark, sf_dir):
    rows = role(spark, sf_dir, "vectors").select(
        "u_id", F.lit("acme").alias("embedding_provider"), F.col("dataset_id").alias("embedding_model"), F.size("embedding").alias("dimension")
    )
    return metrics.vector_stats(rows)


_DASH = """SELECT CASE WHEN l_linestatus = 'F' THEN 'update' END AS intent_type, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS data_category,
        CASE WHEN l_tax > 0.05 THEN '' WHEN l_tax > 0.03 THEN NULL ELSE CONCAT('api_', CAST(l_suppkey AS STRING)) END AS api_name FROM {lineitem}"""


@query("dashboard_stats", f"""
    WITH r AS ({_DASH}), h AS (SELECT coalesce(intent_type, data_category, 'unknown') AS name, count(*) AS n FROM r GROUP BY 1)
    SELECT 'intent' AS kind, name, n FROM h UNION ALL SELECT 'total_intents', NULL, count(*) FROM h
    UNION ALL SELECT 'unique_apis', NULL, count(DISTINCT api_name) FROM r WHERE api_name <> ''""")
def _(spark, sf_dir):
    return metrics.dashboard_stats(spark.sql(_DASH, lineitem=table(spark, sf_dir, "lineitem")))


TELEMETRY_SQL = """
    SELECT date_trunc('minute', ts) AS minute, CAST(trunc(avg(search_latency_ms)) AS BIGINT) AS search_ms, CAST(coalesce(trunc(avg(embedding_latency_ms) FILTER (embedding_latency_ms <> 0)), 0) AS BIGINT) AS embedding_ms,
           CAST(coalesce(trunc(avg(reranker_latency_ms) FILTER (reranker_latency_ms <> 0)), 0) AS BIGINT) AS reranker_ms, count(*) AS n FROM {telemetry} GROUP BY 1"""


@query("telemetry_per_minute", TELEMETRY_SQL)
def _(spark, sf_dir):
    return metrics.telemetry_per_minute(role(spark, sf_dir, "telemetry"))


@query("telemetry_last_minutes", f"SELECT * FROM ({TELEMETRY_SQL}) ORDER BY minute DESC LIMIT 60")
def _(spark, sf_dir):
    return metrics.telemetry_per_minute(role(spark, sf_dir, "telemetry"), last=60)


_CALLS = """SELECT o_orderpriority AS provider, CASE WHEN o_custkey < 700 THEN 'small' ELSE 'large' END AS model, CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'success' END AS status,
        o_totalprice / 100 AS latency_ms, o_custkey AS prompt_tokens, o_orderkey AS completion_tokens FROM {orders}"""


@query("usage_rollup", f"""
    SELECT provider, model, status, count(*) AS calls, round(sum(latency_ms), 2) AS total_ms, round(avg(latency_ms), 4) AS mean_ms, round(max(latency_ms), 4) AS max_ms FROM ({_CALLS}) GROUP BY ALL""")
def _(spark, sf_dir):
    out = metrics.usage_rollup(spark.sql(_CALLS, orders=table(spark, sf_dir, "orders")))
    return out.withColumns({"total_ms": F.round("total_ms", 2), "mean_ms": F.round("mean_ms", 4), "max_ms": F.round("max_ms", 4)})


@query("token_usage", f"""
    SELECT provider, model, 'prompt' AS token_type, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM ({_CALLS}) GROUP BY ALL
    UNION ALL SELECT provider, model, 'completion', CAST(sum(completion_tokens) AS BIGINT) FROM ({_CALLS}) GROUP BY ALL""")
def _(spark, sf_dir):
    return metrics.token_usage(spark.sql(_CALLS, orders=table(spark, sf_dir, "orders")))


_BOUNDS = ", ".join(str(b) for b in metrics.BUCKETS["http"])
HISTOGRAM_SQL = f"""
    SELECT path, le, count(*) FILTER (duration_ms <= le) AS n FROM {{http}}, (SELECT CAST(unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS DOUBLE) AS le) GROUP BY path, le"""


@query("latency_histogram", f"SELECT path, CASE WHEN isinf(le) THEN -1.0 ELSE le END AS le, n FROM ({HISTOGRAM_SQL})")
def _(spark, sf_dir):
    out = metrics.latency_histogram(role(spark, sf_dir, "http"), ["path"], "duration_ms", metrics.BUCKETS["http"])
    return out.withColumn("le", F.when(F.col("le") == metrics.INF, -1.0).otherwise(F.col("le")))


def quantile_sql(histogram: str, q: float, group: str) -> str:
    return f"""
    SELECT {group}, CASE WHEN isinf(le) THEN prev_le ELSE prev_le + (le - prev_le) * (rank - prev_n) / (n - prev_n) END AS quantile FROM (
      SELECT *, coalesce(lag(le) OVER (PARTITION BY {group} ORDER BY le), 0.0) AS prev_le, coalesce(lag(n) OVER (PARTITION BY {group} ORDER BY le), 0) AS prev_n,
             max(n) OVER (PARTITION BY {group}) * {q}::DOUBLE AS rank FROM ({histogram})) WHERE n >= rank AND n > 0
    QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY le) = 1"""


@query("histogram_quantile", f"SELECT path, round(quantile, 6) AS quantile FROM ({quantile_sql(HISTOGRAM_SQL, 0.99, 'path')})")
def _(spark, sf_dir):
    histogram = metrics.latency_histogram(role(spark, sf_dir, "http"), ["path"], "duration_ms", metrics.BUCKETS["http"])
    return metrics.histogram_quantile(histogram, 0.99, ["path"]).withColumn("quantile", F.round("quantile", 6))


@query("sustained", """
    WITH m AS (SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS t FROM {events} GROUP BY ALL HAVING count(*) >= 1),
    r AS (SELECT user_id, t, t - 3600 * row_number() OVER (PARTITION BY user_id ORDER BY t) AS run FROM m),
    i AS (SELECT user_id, run, min(t) AS a, max(t) AS b FROM r GROUP BY ALL HAVING max(t) - min(t) >= 3600)
    SELECT user_id, make_timestamp(a * 1000000) AS started_at, make_timestamp((a + 3600) * 1000000) AS fired_at, make_timestamp(b * 1000000) AS last_at FROM i""")
def _(spark, sf_dir):
    hourly = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").alias("n"))
    return metrics.sustained(hourly, F.col("n") >= 1, "at", 3600, 3600, ["user_id"])
