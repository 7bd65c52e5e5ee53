"""
The part each driver table plays in the data model, as SQL both engines accept.

``role(spark, sf_dir, "audit")`` gives the DataFrame; ``{audit}`` inside an oracle
text expands to the same derivation as a parenthesised subquery.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from waymark.plans.registry import TABLES, spread_table, table

ROLES: dict[str, str] = {
    # action log
    "audit": """
        SELECT event_id AS log_id, user_id, event_type AS action,
               CASE event_type WHEN 'purchase' THEN 'order' WHEN 'signup' THEN 'user'
                               WHEN 'error' THEN NULL ELSE 'page' END AS resource_type,
               CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
               props AS detail, ts AS created_at
        FROM {events}""",
    # one point per search; a click never reaches the reranker, a view has no embedding time
    "telemetry": """
        SELECT event_id, ts, user_id, value AS search_latency_ms,
               CASE WHEN event_type = 'view' THEN NULL ELSE value * 2 END AS embedding_latency_ms,
               CASE WHEN event_type = 'click' THEN 0.0 ELSE value * 3 END AS reranker_latency_ms
        FROM {events}""",
    # outcome of calls to a dependency, one dependency per user
    "outcomes": """
        SELECT event_id, user_id AS name, ts, event_type <> 'error' AS success FROM {events}""",
    # HTTP requests
    "http": """
        SELECT event_id, ts, user_id AS client, event_type AS path, value * 100 AS duration_ms,
               CASE WHEN event_type = 'error' AND value > 20 THEN 500
                    WHEN event_type = 'signup' AND value > 60 THEN 429 ELSE 200 END AS status_code
        FROM {events}""",
    # utterance files and their embedding state
    "datasets": """
        SELECT o_orderkey AS dataset_id, o_custkey AS t_id,
               CONCAT('tenant-', SUBSTRING(o_orderpriority, 1, 1)) AS u_id,
               CONCAT('Set ', o_orderpriority) AS name,
               CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS embedding_status,
               CASE WHEN o_totalprice > 450000 THEN NULL ELSE CAST(FLOOR(o_totalprice / 1000) AS BIGINT) END AS total_rows,
               CASE WHEN o_totalprice > 450000 THEN NULL WHEN o_orderstatus = 'F' THEN CAST(FLOOR(o_totalprice / 1000) AS BIGINT)
                    WHEN o_orderstatus = 'P' THEN CAST(FLOOR(o_totalprice / 3000) AS BIGINT) ELSE 0 END AS embedded_rows,
               CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'ollama'
                    WHEN '3-MEDIUM' THEN 'openai' ELSE 'voyage' END AS embedding_provider,
               CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'nomic-embed-text'
                    ELSE 'text-embed-3' END AS embedding_model,
               CASE WHEN o_orderpriority = '5-LOW' THEN 1024 ELSE 768 END AS embedding_dimension,
               CASE WHEN o_orderpriority < '3' THEN TRUE ELSE FALSE END AS generated_with_llm,
               o_orderdate AS created_at
        FROM {orders}""",
    # the API catalogue with its approval metadata
    "templates": """
        SELECT c_custkey AS t_id, c_nationkey AS u_id, c_name AS api_name,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE CONCAT('/v1/', LOWER(c_mktsegment), '/', CAST(c_custkey AS STRING)) END AS endpoint,
               CONCAT('/legacy/', CAST(c_custkey AS STRING)) AS legacy_field,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'GET' WHEN 'MACHINERY' THEN 'PUT' WHEN 'HOUSEHOLD' THEN 'DELETE' ELSE 'POST' END AS method
        FROM {customer}""",
    "template_metadata": """
        SELECT c_custkey AS t_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'draft' WHEN 'MACHINERY' THEN 'review'
                    WHEN 'HOUSEHOLD' THEN 'approved' ELSE 'rejected' END AS status
        FROM {customer} WHERE c_acctbal > 0""",
    # generated test cases
    "cases": """
        SELECT l_orderkey AS dataset_id, l_linenumber AS line_no, CAST(l_partkey AS STRING) AS part_ref,
               CASE WHEN l_tax > 0.07 THEN NULL ELSE CONCAT('move part ', CAST(l_partkey AS STRING), ' to ', CAST(l_suppkey AS STRING)) END AS query,
               CASE WHEN l_linestatus = 'F' THEN CONCAT('api_', CAST(l_suppkey AS STRING)) ELSE NULL END AS api,
               CASE WHEN l_discount > 0.05 THEN CONCAT('{{"qty": ', CAST(CAST(l_quantity AS BIGINT) AS STRING), '}}') ELSE NULL END AS request,
               CASE l_returnflag WHEN 'N' THEN 'valid' WHEN 'A' THEN 'edge_case' ELSE 'Extreme' END AS scenario_type,
               CASE WHEN l_linenumber = 1 THEN 'typo' WHEN l_linenumber = 2 THEN 'Security' WHEN l_linenumber = 3 THEN 'made_up' ELSE NULL END AS test_category,
               CASE WHEN l_linestatus = 'F' THEN 'update' ELSE 'nonsense' END AS intent_type,
               CASE WHEN l_discount = 0.0 THEN 0.5 ELSE NULL END AS confidence_score,
               l_shipdate AS created_at
        FROM {lineitem}""",
    # catalogue of models kept so far, and what the providers list now
    "model_catalog": """
        SELECT p_brand AS provider, CASE WHEN p_size % 2 = 0 THEN 'global' ELSE 'tenant-1' END AS scope,
               CONCAT(p_name, '-', CAST(p_partkey AS STRING)) AS model_id,
               CASE WHEN p_type = 'SMALL' THEN 'embedding' ELSE 'llm' END AS kind,
               CASE WHEN p_retailprice < 1000 THEN 'active' WHEN p_retailprice < 1060 THEN 'deprecated' ELSE 'retired' END AS status,
               CASE WHEN p_retailprice >= 1000 AND p_retailprice < 1060 THEN CAST(DATE '2024-01-01' - INTERVAL '1' DAY * p_size AS TIMESTAMP) END AS missing_since,
               CASE WHEN p_retailprice >= 1060 THEN CAST(DATE '2024-01-01' - INTERVAL '1' DAY * p_size AS TIMESTAMP) END AS retired_at,
               CAST(DATE '2024-01-01' - INTERVAL '1' DAY * p_size AS TIMESTAMP) AS first_seen_at
        FROM {part} WHERE p_size <= 40""",
    "model_listing": """
        SELECT p_brand AS provider, CASE WHEN p_size % 2 = 0 THEN 'global' ELSE 'tenant-1' END AS scope,
               CONCAT(p_name, '-', CAST(p_partkey AS STRING)) AS model_id,
               CASE WHEN p_type = 'SMALL' THEN 'embedding' ELSE 'llm' END AS kind,
               CASE WHEN p_type = 'PROMO' THEN CAST(DATE '2024-01-20' - INTERVAL '1' DAY * p_size AS DATE) END AS shutdown_date
        FROM {part} WHERE p_type <> 'ECONOMY'""",
    # indexed utterances: text and vector of the same number, language as tenant, label as template
    "vectors": """
        SELECT v.vec_id AS row_uid, d.lang AS u_id, CAST(v.label AS BIGINT) AS t_id, d.source AS dataset_id,
               d.text AS query, v.embedding AS embedding
        FROM {embeddings} v JOIN {documents} d ON v.vec_id = d.doc_id""",
}


def _split(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)


def role(spark: SparkSession, sf_dir: str, name: str, spread: tuple[str, ...] = ()) -> DataFrame:
    """The DataFrame of a role; tables in ``spread`` are read in at least one part per core."""
    sql = ROLES[name]
    frames = {n: (spread_table if n in spread else table)(spark, sf_dir, n) for n in set(_split(sql))}
    return spark.sql(sql, **frames)


def expand(sql: str) -> str:
    """Replace ``{role}`` and ``{table}`` placeholders for DuckDB."""

    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name in ROLES:
            return "(" + expand(ROLES[name]).strip() + ")"
        if name in TABLES:
            return name
        raise KeyError(name)

    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", fill, sql).replace("{{", "{").replace("}}", "}")
