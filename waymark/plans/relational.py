"""Scoping, paging, lifecycle and catalogue joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waymark.operators import audit, datasets, scoping, templates
from waymark.plans.registry import query, table
from waymark.plans.roles import role

NOW = dt.datetime(1999, 1, 1, tzinfo=dt.timezone.utc)


@query("tenant_scope", "SELECT row_uid, u_id, t_id, dataset_id FROM {vectors} WHERE u_id = 'de'")
def _(spark, sf_dir):
    return scoping.tenant_scope(role(spark, sf_dir, "vectors"), "de").select("row_uid", "u_id", "t_id", "dataset_id")


@query("tenant_scope_unset", "SELECT count(*) AS n FROM {vectors} WHERE u_id = NULL")
def _(spark, sf_dir):
    return scoping.tenant_scope(role(spark, sf_dir, "vectors"), None).agg(F.count("*").alias("n"))


@query("equality_filters", "SELECT dataset_id, t_id, u_id FROM {datasets} WHERE embedding_status = 'completed' AND u_id = 'tenant-2'")
def _(spark, sf_dir):
    rows = scoping.equality_filters(role(spark, sf_dir, "datasets"), embedding_status="completed", u_id="tenant-2", t_id=None)
    return rows.select("dataset_id", "t_id", "u_id")


@query("name_contains", "SELECT dataset_id, name FROM {datasets} WHERE name ILIKE '%-high%'")
def _(spark, sf_dir):
    return scoping.name_contains(role(spark, sf_dir, "datasets"), "name", "-HIGH").select("dataset_id", "name")


@query("audit_filter", """
    SELECT log_id, user_id, created_at FROM {audit} WHERE action = 'purchase' AND resource_type = 'order' AND success = 1
      AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'""")
def _(spark, sf_dir):
    plus2 = dt.timezone(dt.timedelta(hours=2))
    rows = audit.audit_filter(
        role(spark, sf_dir, "audit"), action="purchase", resource_type="order", success=True,
        start=dt.datetime(2024, 1, 5, 2, tzinfo=plus2), end=dt.datetime(2024, 1, 20, 12, tzinfo=dt.timezone.utc),
    )
    return rows.select("log_id", "user_id", "created_at")


@query("page", """
    SELECT dataset_id, created_at, (SELECT count(*) FROM {datasets} WHERE embedding_status = 'pending') AS total
    FROM {datasets} WHERE embedding_status = 'pending' ORDER BY created_at DESC, dataset_id LIMIT 50 OFFSET 100""")
def _(spark, sf_dir):
    rows = scoping.equality_filters(role(spark, sf_dir, "datasets"), embedding_status="pending").select("dataset_id", "created_at")
    return scoping.page(rows, "created_at", offset=100, limit=50, tie_break="dataset_id")


@query("preview", """
    SELECT doc_id, lang, (SELECT count(*) FROM {documents}) AS total, (SELECT count(*) FROM {documents}) > 70 AS has_more
    FROM {documents} ORDER BY doc_id LIMIT 50 OFFSET 20""")
def _(spark, sf_dir):
    return scoping.preview(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], offset=20, limit=50)


@query("preview_value_counts", """
    SELECT 'scenario_type' AS col, scenario_type AS value, count(*) AS n FROM {cases} GROUP BY 2
    UNION ALL SELECT 'test_category', test_category, count(*) FROM {cases} WHERE test_category IS NOT NULL GROUP BY 2""")
def _(spark, sf_dir):
    rows = role(spark, sf_dir, "cases")
    parts = [scoping.value_counts(rows, c).select(F.lit(c).alias("col"), "value", "n") for c in ("scenario_type", "test_category")]
    return parts[0].unionByName(parts[1])


@query("rows_by_scenario", """
    SELECT doc_id, (SELECT count(*) FROM {documents} WHERE source = 'src3' AND lang = 'en') AS total
    FROM {documents} WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id DESC LIMIT 50""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id"), F.col("lang").alias("scenario_type"))
    return scoping.page(scoping.rows_by_scenario(rows, "src3", "en"), "doc_id").select("doc_id", "total")


@query("exists_by_key", "SELECT count(*) > 0 AS found FROM {datasets} WHERE dataset_id = 7")
def _(spark, sf_dir):
    return scoping.exists(role(spark, sf_dir, "datasets"), F.col("dataset_id") == 7)


@query("recent_tasks", """
    SELECT o_orderkey AS task_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created_at, embedding_status AS status
    FROM {orders} o JOIN {datasets} d ON o.o_orderkey = d.dataset_id
    WHERE embedding_status <> 'completed' AND (o_orderpriority = '5-LOW' OR o_orderdate >= TIMESTAMP '1998-12-02')""")
def _(spark, sf_dir):
    low = F.col("name").contains("5-LOW")
    tasks = role(spark, sf_dir, "datasets").select(
        F.col("dataset_id").alias("task_id"), F.col("embedding_status").alias("status"),
        F.when(low, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd")).alias("created_at"),
    )
    return datasets.recent_tasks(tasks, NOW, max_age_hours=24 * 30, include_completed=False)


@query("task_status_counts", "SELECT embedding_status AS status, count(*) AS n FROM {datasets} GROUP BY 1")
def _(spark, sf_dir):
    return datasets.task_status_counts(role(spark, sf_dir, "datasets").withColumnRenamed("embedding_status", "status"))


def _jobs(spark, sf_dir):
    done = F.floor(F.col("embedded_rows") * 100 / F.greatest(F.col("total_rows"), F.lit(1))).cast("int")
    return role(spark, sf_dir, "datasets").withColumns({"embedding_progress": done, "embedding_error": F.lit(None).cast("string")})


@query("stale_jobs", "SELECT dataset_id FROM {datasets} WHERE embedding_status = 'in_progress' AND created_at < TIMESTAMP '1998-12-31 23:30:00'")
def _(spark, sf_dir):
    return datasets.stale_jobs(_jobs(spark, sf_dir), NOW).select("dataset_id")


@query("reset_stale", """
    SELECT dataset_id, CASE WHEN stale THEN 'pending' ELSE embedding_status END AS embedding_status,
           CASE WHEN stale THEN 'Interrupted: reset after server restart (was ' || CAST(coalesce(floor(embedded_rows * 100 / greatest(total_rows, 1)), 0)::BIGINT AS VARCHAR)
                || '% done, ' || CAST(coalesce(embedded_rows, 0) AS VARCHAR) || ' rows embedded)' END AS embedding_error
    FROM (SELECT *, embedding_status = 'in_progress' AND created_at < TIMESTAMP '1998-12-31 23:30:00' AS stale FROM {datasets})""")
def _(spark, sf_dir):
    return datasets.reset_stale(_jobs(spark, sf_dir), NOW).select("dataset_id", "embedding_status", "embedding_error")


@query("advance_embedding_status", """
    SELECT dataset_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'failed' WHEN '3-MEDIUM' THEN 'in_progress' ELSE embedding_status END AS embedding_status,
           CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 100 ELSE floor(embedded_rows * 100 / greatest(total_rows, 1)) END AS INT) AS embedding_progress,
           CASE o_orderpriority WHEN '2-HIGH' THEN 'boom' END AS embedding_error,
           CASE o_orderpriority WHEN '3-MEDIUM' THEN 12 ELSE embedded_rows END AS embedded_rows
    FROM {datasets} d JOIN {orders} o ON o.o_orderkey = d.dataset_id""")
def _(spark, sf_dir):
    p = F.col("o_orderpriority")
    updates = table(spark, sf_dir, "orders").filter(p < "4").select(
        F.col("o_orderkey").alias("dataset_id"),
        F.when(p == "1-URGENT", "completed").when(p == "2-HIGH", "failed").otherwise("in_progress").alias("status"),
        F.when(p == "1-URGENT", 40).when(p == "2-HIGH", -5).otherwise(130).alias("progress"),
        F.when(p != "3-MEDIUM", "boom").alias("error"),
        F.when(p == "3-MEDIUM", F.lit(12).cast("bigint")).alias("embedded_rows"),
    )
    return datasets.advance_embedding_status(_jobs(spark, sf_dir), updates).select(
        "dataset_id", "embedding_status", "embedding_progress", "embedding_error", "embedded_rows"
    )


@query("normalise_audit", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN '123e4567-e89b-12d3-a456-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS resource_id,
           CASE event_type WHEN 'error' THEN 'system' ELSE event_type END AS resource_type,
           CASE WHEN event_type = 'error' THEN props END AS error_message, props AS detail,
           CASE WHEN event_type IN ('view', 'error') THEN 'item-' || CAST(event_id AS VARCHAR) END AS resource_id_str
    FROM {events}""")
def _(spark, sf_dir):
    kind, event = F.col("event_type"), F.col("event_id").cast("string")
    logs = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", F.concat(F.lit("123e4567-e89b-12d3-a456-"), F.lpad(event, 12, "0")))
        .when(kind.isin("view", "error"), F.concat(F.lit("item-"), event)).alias("resource_id"),
        F.when(kind != "error", kind).alias("resource_type"),
        F.when(kind == "error", 0).otherwise(1).alias("success"), F.col("props").alias("detail"), F.lit("a@b.c").alias("user_email"),
    )
    out = audit.normalise_audit(logs)
    meta = F.col("metadata")
    return out.select("event_id", "resource_id", "resource_type", "error_message", meta["detail"].alias("detail"), meta["resource_id_str"].alias("resource_id_str"))


@query("audit_stats", """
    SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n, count(*) FILTER (success = 1) AS n_success, count(*) FILTER (success <> 1) AS n_failed FROM {audit} WHERE created_at >= TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'action', action, count(*), count(*) FILTER (success = 1), count(*) FILTER (success <> 1) FROM {audit} WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY 2
    UNION ALL SELECT 'resource', resource_type, count(*), count(*) FILTER (success = 1), count(*) FILTER (success <> 1) FROM {audit} WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY 2""")
def _(spark, sf_dir):
    return audit.audit_stats(role(spark, sf_dir, "audit"), start=dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc))


@query("recent_k", """
    SELECT user_id, log_id, rank FROM (SELECT user_id, log_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id DESC) AS INT) AS rank FROM {audit}) WHERE rank <= 10""")
def _(spark, sf_dir):
    return audit.recent_k(role(spark, sf_dir, "audit"), 10).select("user_id", "log_id", "rank")


@query("datasets_with_template", """
    SELECT dataset_id, d.t_id, api_name AS template_name, CASE WHEN generated_with_llm THEN 'AI_GENERATED' ELSE 'CSV_UPLOAD' END AS source_type
    FROM {datasets} d LEFT JOIN {templates} t ON d.t_id = t.t_id AND t.u_id < 20""")
def _(spark, sf_dir):
    known = role(spark, sf_dir, "templates").filter("u_id < 20")
    out = templates.datasets_with_template(role(spark, sf_dir, "datasets"), known)
    return out.select("dataset_id", "t_id", "template_name", "source_type")


@query("templates_by_status", """
    SELECT t.t_id, api_name, status FROM {templates} t JOIN {template_metadata} m ON t.t_id = m.t_id WHERE status = 'review'""")
def _(spark, sf_dir):
    out = templates.templates_by_status(role(spark, sf_dir, "templates"), role(spark, sf_dir, "template_metadata"), "review")
    return out.select("t_id", "api_name", "status")


@query("template_status_counts", """
    SELECT count(*) AS total_templates, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'review') AS review,
           count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected
    FROM {templates} t LEFT JOIN {template_metadata} m ON t.t_id = m.t_id""")
def _(spark, sf_dir):
    return templates.template_status_counts(role(spark, sf_dir, "templates"), role(spark, sf_dir, "template_metadata"))


@query("resolve_template", """
    SELECT o_orderkey, o_custkey AS t_id, api_name AS resolved_api, coalesce(endpoint, legacy_field) AS resolved_endpoint, method AS resolved_method,
           CASE WHEN t.t_id IS NULL THEN 'TEMPLATE_NOT_FOUND' END AS error
    FROM {orders} o LEFT JOIN {templates} t ON o.o_custkey = t.t_id AND t.u_id > 3""")
def _(spark, sf_dir):
    winners = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("t_id"))
    return templates.resolve_template(winners, role(spark, sf_dir, "templates").filter("u_id > 3"))


@query("route_ids", """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey AS dataset_id, 'Customer#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS api_name FROM {lineitem})
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(d.o_custkey, t.c_custkey) AS t_id, coalesce(d.o_custkey, t.c_custkey) IS NULL AS unroutable
    FROM r LEFT JOIN (SELECT * FROM {orders} WHERE o_orderstatus = 'F') d ON d.o_orderkey = r.dataset_id LEFT JOIN (SELECT * FROM {customer} WHERE c_acctbal > 0) t ON t.c_name = r.api_name""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("dataset_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("api_name"),
    )
    sets = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("t_id"))
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("t_id"), F.col("c_name").alias("api_name"))
    return templates.route_ids(rows, sets, known).drop("dataset_id", "api_name")


@query("latest_per_key", """
    SELECT t_id, dataset_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY created_at DESC, dataset_id) AS n FROM {datasets}) WHERE n = 1""")
def _(spark, sf_dir):
    rows = role(spark, sf_dir, "datasets").select("t_id", "dataset_id", "created_at")
    return datasets.latest_per_key(rows, "t_id", "created_at", "dataset_id")


@query("embedding_groups", """
    SELECT u_id, coalesce(embedding_provider, 'ollama') AS provider, embedding_model AS model_id, embedding_dimension AS dimension,
           count(*) AS n_datasets, CAST(sum(coalesce(embedded_rows, 0)) AS BIGINT) AS n_rows, max(created_at) AS newest
    FROM {datasets} WHERE embedding_status = 'completed' AND embedding_model IS NOT NULL GROUP BY ALL""")
def _(spark, sf_dir):
    return datasets.embedding_groups(role(spark, sf_dir, "datasets"))


@query("group_members", """
    SELECT u_id, coalesce(embedding_provider, 'ollama') AS provider, embedding_model AS model_id, embedding_dimension AS dimension, dataset_id,
           name, coalesce(embedded_rows, 0) AS rows FROM {datasets} WHERE embedding_status = 'completed' AND embedding_model IS NOT NULL""")
def _(spark, sf_dir):
    return datasets.group_members(role(spark, sf_dir, "datasets")).drop("created_at")


_ACTIVE = "SELECT DISTINCT u_id, 'ollama' AS active_provider, 'nomic-embed-text' AS active_model, 768 AS active_dimension FROM {datasets}"


@query("embedding_mismatch", f"""
    SELECT dataset_id, d.u_id, coalesce(embedding_provider, 'ollama') AS provider,
           'Search with ' || embedding_model || ' / Re-embed with nomic-embed-text' AS labels
    FROM {{datasets}} d JOIN ({_ACTIVE}) a ON a.u_id = d.u_id
    WHERE embedding_model IS NOT NULL AND NOT (coalesce(embedding_provider, 'ollama') = 'ollama' AND embedding_model = 'nomic-embed-text' AND embedding_dimension = 768)""")
def _(spark, sf_dir):
    sets = role(spark, sf_dir, "datasets")
    active = spark.sql(_ACTIVE, datasets=sets)
    out = datasets.embedding_mismatch(sets, active)
    return out.select("dataset_id", "u_id", "provider", F.array_join(F.transform("options", lambda o: o["label"]), " / ").alias("labels"))


@query("preferred_connection", """
    SELECT u_id, provider, config_id FROM (
      SELECT *, row_number() OVER (PARTITION BY u_id, provider ORDER BY is_default DESC, updated_at DESC NULLS LAST, config_id) AS n FROM (
        SELECT o_custkey AS u_id, o_orderpriority AS provider, o_orderkey AS config_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS is_active,
               CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS is_default, CASE WHEN o_totalprice > 200000 THEN o_orderdate END AS updated_at FROM {orders}) WHERE is_active = 1) WHERE n = 1""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("u_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("config_id"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("is_active"),
        F.when(F.col("o_totalprice") > 300000, 1).otherwise(0).alias("is_default"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate")).alias("updated_at"),
    )
    return datasets.preferred_connection(rows).select("u_id", "provider", "config_id")


@query("embedding_progress", """
    SELECT l_orderkey AS dataset_id, count(*) AS total_rows, count(*) FILTER (l_linestatus = 'F') AS embedded_rows, count(*) FILTER (l_returnflag = 'R') AS unroutable_rows,
           CAST(floor(count(*) FILTER (l_linestatus = 'F') * 100 / count(*)) AS BIGINT) AS progress, count(*) FILTER (l_linestatus <> 'F') AS failed_rows
    FROM {lineitem} GROUP BY 1""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"), (F.col("l_linestatus") == "F").alias("embedded"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("t_id"),
    )
    return datasets.embedding_progress(rows)


@query("dataset_stats", """
    SELECT count(*) AS datasets, CAST(coalesce(sum(total_rows), 0) AS BIGINT) AS total_rows, CAST(coalesce(sum(embedded_rows), 0) AS BIGINT) AS embedded_rows,
           count(*) FILTER (embedding_status = 'pending') AS pending, count(*) FILTER (embedding_status = 'in_progress') AS in_progress,
           count(*) FILTER (embedding_status = 'completed') AS completed, count(*) FILTER (embedding_status = 'failed') AS failed FROM {datasets}""")
def _(spark, sf_dir):
    return datasets.dataset_stats(role(spark, sf_dir, "datasets"))
