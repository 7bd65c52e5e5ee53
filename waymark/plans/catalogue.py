"""The model catalogue lifecycle over the part table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waymark.operators import catalogue
from waymark.plans.registry import query, table
from waymark.plans.roles import role

NOW = dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc)

# Brands 1x had one failing listing, brands 2x none that worked.
_GROUPS = """SELECT DISTINCT provider, scope, provider NOT LIKE 'Brand#2%' AS listed_ok,
        CASE WHEN provider LIKE 'Brand#1%' THEN 1 ELSE 0 END AS failures FROM {model_listing}"""

_SYNC = f"""
    SELECT coalesce(e.scope, l.scope) AS scope, coalesce(e.provider, l.provider) AS provider, coalesce(e.model_id, l.model_id) AS model_id,
           e.status, e.missing_since, e.retired_at, l.model_id IS NOT NULL AS seen, l.shutdown_date, g.listed_ok, g.failures,
           CASE WHEN NOT coalesce(listed_ok, FALSE) THEN (CASE WHEN e.model_id IS NOT NULL THEN 'unchanged' END)
                WHEN l.model_id IS NOT NULL AND e.model_id IS NULL THEN (CASE WHEN shutdown_date <= DATE '2024-01-05' THEN 'added_retired' ELSE 'added' END)
                WHEN l.model_id IS NOT NULL AND shutdown_date <= DATE '2024-01-05' THEN 'retired'
                WHEN l.model_id IS NOT NULL THEN 'active'
                WHEN failures > 0 THEN 'unchanged'
                WHEN e.status = 'active' THEN 'deprecated'
                WHEN e.status = 'deprecated' AND missing_since <= TIMESTAMP '2024-01-02' THEN 'retired'
                ELSE 'unchanged' END AS transition
    FROM {{model_catalog}} e FULL OUTER JOIN {{model_listing}} l ON e.scope = l.scope AND e.provider = l.provider AND e.model_id = l.model_id
    LEFT JOIN ({_GROUPS}) g ON g.provider = coalesce(e.provider, l.provider) AND g.scope = coalesce(e.scope, l.scope)"""


def _synced(spark, sf_dir):
    listing = role(spark, sf_dir, "model_listing")
    groups = spark.sql(_GROUPS, model_listing=listing)
    return catalogue.sync_catalog(role(spark, sf_dir, "model_catalog"), listing, groups, NOW)


@query("sync_catalog", f"""
    SELECT scope, provider, model_id, transition,
           CASE WHEN transition IN ('retired', 'added_retired') THEN 'retired' WHEN transition IN ('added', 'active') THEN 'active'
                WHEN transition = 'deprecated' THEN 'deprecated' ELSE status END AS status,
           CASE WHEN listed_ok AND seen THEN NULL WHEN transition = 'deprecated' THEN TIMESTAMP '2024-01-05' ELSE missing_since END AS missing_since,
           CASE WHEN transition IN ('retired', 'added_retired') AND status IS DISTINCT FROM 'retired' THEN TIMESTAMP '2024-01-05'
                WHEN transition IN ('added', 'active') THEN NULL ELSE retired_at END AS retired_at
    FROM ({_SYNC}) WHERE transition IS NOT NULL""")
def _(spark, sf_dir):
    return _synced(spark, sf_dir).drop("kind", "first_seen_at")


@query("sync_transition_counts", f"SELECT scope, provider, transition, count(*) AS n FROM ({_SYNC}) WHERE transition IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    return catalogue.transition_counts(_synced(spark, sf_dir))


@query("retire_orphans", """
    SELECT scope, provider, model_id, CASE WHEN provider IN (SELECT provider FROM {model_listing} WHERE kind = 'embedding') THEN status ELSE 'retired' END AS status,
           CASE WHEN status <> 'retired' AND provider NOT IN (SELECT provider FROM {model_listing} WHERE kind = 'embedding') THEN TIMESTAMP '2024-01-05' ELSE retired_at END AS retired_at
    FROM (SELECT * FROM {model_catalog} WHERE scope = 'global')""")
def _(spark, sf_dir):
    catalog = role(spark, sf_dir, "model_catalog").filter("scope = 'global'")
    live = role(spark, sf_dir, "model_listing").filter("kind = 'embedding'").select(F.lit("global").alias("scope"), "provider")
    return catalogue.retire_orphans(catalog, live, NOW).select("scope", "provider", "model_id", "status", "retired_at")


@query("live_sources", """
    SELECT s.scope, s.provider FROM (SELECT DISTINCT scope, provider FROM {model_listing}) s
    WHERE EXISTS (SELECT 1 FROM {model_listing} l WHERE l.kind = 'embedding' AND l.scope = s.scope AND l.provider = s.provider)
       OR EXISTS (SELECT 1 FROM {model_catalog} c WHERE c.status = 'retired' AND c.scope = s.scope AND c.provider = s.provider)""")
def _(spark, sf_dir):
    listing = role(spark, sf_dir, "model_listing")
    return catalogue.live_sources(
        catalogue.distinct_groups(listing), listing.filter("kind = 'embedding'"), role(spark, sf_dir, "model_catalog").filter("status = 'retired'")
    )


# who still uses which model: connections name parts of an order line, datasets name embedding models
_CONNECTIONS = """SELECT DISTINCT p.p_brand AS provider, CONCAT(p.p_name, '-', CAST(p.p_partkey AS STRING)) AS model_name, 'tenant-1' AS u_id
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 48"""
_NAMED = """SELECT DISTINCT CONCAT(p.p_name, '-', CAST(p.p_partkey AS STRING), ':latest') AS embedding_model, 'tenant-1' AS u_id
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_quantity < 2"""
_SETTINGS = """SELECT DISTINCT CONCAT(p.p_name, '-', CAST(p.p_partkey AS STRING)) AS default_embedding_model, 'tenant-2' AS u_id
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_quantity = 3"""


@query("delete_unused_retired", f"""
    SELECT scope, provider, model_id, status FROM {{model_catalog}} c
    WHERE NOT (status = 'retired' AND retired_at <= TIMESTAMP '2023-12-29'
      AND NOT EXISTS (SELECT 1 FROM ({_CONNECTIONS}) r WHERE c.kind = 'llm' AND r.provider = c.provider AND r.model_name = c.model_id AND c.scope IN ('global', r.u_id))
      AND NOT EXISTS (SELECT 1 FROM ({_NAMED}) r WHERE c.kind = 'embedding' AND (r.embedding_model = c.model_id OR r.embedding_model = c.model_id || ':latest') AND c.scope IN ('global', r.u_id))
      AND NOT EXISTS (SELECT 1 FROM ({_SETTINGS}) r WHERE c.kind = 'embedding' AND r.default_embedding_model IN (c.model_id, c.model_id || ':latest') AND c.scope IN ('global', r.u_id)))""")
def _(spark, sf_dir):
    frames = {"lineitem": table(spark, sf_dir, "lineitem"), "part": table(spark, sf_dir, "part")}
    connections, named, settings = (spark.sql(s, **frames) for s in (_CONNECTIONS, _NAMED, _SETTINGS))
    refs = catalogue.referenced_models(connections, named, settings)
    out = catalogue.delete_unused_retired(role(spark, sf_dir, "model_catalog"), refs, NOW)
    return out.select("scope", "provider", "model_id", "status")


# the same model can be listed for everyone and with a personal key
_SHOWN = """SELECT provider, model_id, kind, status, scope FROM {model_catalog}
        UNION ALL SELECT provider, model_id, kind, 'active', 'tenant-1' FROM {model_catalog} WHERE scope = 'global'
        UNION ALL SELECT provider, model_id, kind, 'active', 'tenant-9' FROM {model_catalog}"""


@query("visible_catalog", f"""
    SELECT provider, model_id, scope, status FROM (SELECT *, row_number() OVER (PARTITION BY provider, model_id ORDER BY CASE scope WHEN 'global' THEN 0 ELSE 1 END) AS n
        FROM ({_SHOWN}) WHERE scope IN ('global', 'tenant-1') AND kind = 'llm' AND status <> 'retired') WHERE n = 1""")
def _(spark, sf_dir):
    shown = spark.sql(_SHOWN, model_catalog=role(spark, sf_dir, "model_catalog"))
    return catalogue.visible_catalog(shown, "tenant-1", kind="llm").select("provider", "model_id", "scope", "status")


@query("new_model_badge", """
    SELECT model_id, scope, provider, first_seen_at > coalesce(first, first_seen_at) + INTERVAL 5 MINUTE AND first_seen_at > TIMESTAMP '2023-12-29' AS is_new
    FROM {model_catalog} LEFT JOIN (SELECT scope, provider, min(first_seen_at) AS first FROM {model_catalog} WHERE status <> 'retired' GROUP BY ALL) USING (scope, provider)""")
def _(spark, sf_dir):
    catalog = role(spark, sf_dir, "model_catalog")
    sources = catalog.filter("status <> 'retired'").groupBy("scope", "provider").agg(F.min("first_seen_at").alias("first_success_at"))
    return catalogue.new_model_badge(catalog, sources, NOW).select("model_id", "scope", "provider", "is_new")


@query("distinct_groups", "SELECT DISTINCT scope, provider FROM {model_catalog}")
def _(spark, sf_dir):
    return catalogue.distinct_groups(role(spark, sf_dir, "model_catalog"))


@query("merge_listings", """
    SELECT scope, provider, model_id, CASE WHEN n1 > 0 THEN 1 ELSE 2 END AS listing_no FROM (
      SELECT scope, provider, model_id, count(*) FILTER (src = 1) AS n1 FROM (
        SELECT scope, provider, model_id, 1 AS src FROM {model_listing} WHERE kind = 'llm' UNION ALL SELECT scope, provider, model_id, 2 FROM {model_catalog}) GROUP BY ALL)""")
def _(spark, sf_dir):
    cols = ["scope", "provider", "model_id"]
    first = role(spark, sf_dir, "model_listing").filter("kind = 'llm'").select(*cols, F.lit(1).alias("listing_no"))
    second = role(spark, sf_dir, "model_catalog").select(*cols, F.lit(2).alias("listing_no"))
    return catalogue.merge_listings(first.unionByName(second))


@query("exclude_shared", """
    SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 5000 AND o.o_orderpriority = '1-URGENT')""")
def _(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    personal = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(urgent, "ollama").otherwise("openai").alias("provider"), F.col("o_custkey").cast("string").alias("api_key"),
        F.when(urgent, "http://host/").alias("base_url"),
    )
    shared = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(
        F.lit("ollama").alias("provider"), F.col("c_custkey").cast("string").alias("api_key"), F.lit("http://host").alias("base_url")
    )
    return catalogue.exclude_shared(personal, shared).select("o_orderkey")
