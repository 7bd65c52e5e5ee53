"""Utterance and case files, case normalisation, recovery from text, the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import cases, templates
from waymark.plans.registry import query, table
from waymark.plans.roles import role
from waymark.session import fresh_path
from waymark.sources import files, vectors
from waymark.streaming import logs


@query("csv_round_trip", """
    SELECT doc_id, md5(text) AS digest, length(text) AS n_chars, lang, source FROM {documents}
    WHERE text NOT IN ('', ' ', 'NA', 'N/A', 'NULL', 'None', 'nan', 'null', 'NaN', 'n/a')""")
def _(spark, sf_dir):
    path = fresh_path(spark, "cases-csv")
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "query")
    files.write_cases(docs.select("doc_id", "query", "lang", "source"), path)
    back = files.read_utterances(spark, path, schema="doc_id string, query string, lang string, source string")
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.col("query").cast("binary")).alias("digest"),
        F.length("query").cast("bigint").alias("n_chars"), "lang", "source",
    )


@query("json_round_trip", """
    SELECT conv_id, turn, role, md5(text) AS digest, [role, CAST(turn AS VARCHAR)] AS tags FROM {conversations}""")
def _(spark, sf_dir):
    path = fresh_path(spark, "cases-json")
    rows = table(spark, sf_dir, "conversations").withColumn("tags", F.array("role", F.col("turn").cast("string")))
    files.write_cases(rows, path, format="json")
    back = files.read_cases_json(spark, path, rows.schema)
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "tags")


@query("read_utterances_trimmed", """
    SELECT event_id, trim(event_type) AS query FROM {events} WHERE event_type NOT IN ('view', 'signup')""")
def _(spark, sf_dir):
    path = fresh_path(spark, "utterances")
    kind = F.col("event_type")
    said = F.when(kind == "view", None).when(kind == "signup", "   ").otherwise(F.concat(F.lit("  "), kind, F.lit(" ")))
    files.write_cases(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), said.alias("query")), path)
    back = files.read_utterances(spark, path, schema="event_id string, query string", trim_fields=True)
    return back.select(F.col("event_id").cast("bigint").alias("event_id"), "query")


_LOG_FILE = """SELECT event_id, CASE WHEN event_type = 'purchase' THEN CONCAT('plain text ', CAST(event_id AS STRING))
        ELSE CONCAT('{{"timestamp": "2024-03-01T10:00:00.5Z", "severity": "', CASE WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END,
                    '", "message": "', event_type, '", "user_id": "', CAST(user_id AS STRING), '", "execution_time_ms": ', CAST(user_id AS STRING), '}}') END AS value
        FROM {events}"""


_LOGS_SQL = """
    SELECT TIMESTAMP '2024-03-01 10:00:00.5' AS ts, 'INFO' AS severity, event_type AS message, CAST(user_id AS VARCHAR) AS user_id,
           CAST(user_id AS DOUBLE) AS execution_time_ms, count(*) AS n
    FROM {events} WHERE event_type NOT IN ('purchase', 'view') GROUP BY ALL"""
_BROKEN_SQL = "SELECT 'plain text ' || CAST(event_id AS VARCHAR) AS broken FROM {events} WHERE event_type = 'purchase'"


def _log_counts(rows):
    return rows.groupBy("ts", "severity", "message", "user_id", "execution_time_ms").agg(F.count("*").alias("n"))


@query("read_json_logs", _LOGS_SQL)
def _(spark, sf_dir):
    path = fresh_path(spark, "log-lines")
    spark.sql(_LOG_FILE, events=table(spark, sf_dir, "events")).select("value").write.text(path)
    return _log_counts(files.read_json_logs(spark, path))


def _split_logs(spark, sf_dir):
    """The lines arrive as a stream in two lots; the tables of readable rows and of broken lines."""
    path, kept, broken, checkpoint = (fresh_path(spark, label) for label in ("log-stream", "log-rows", "log-broken", "log-checkpoint"))
    lines = spark.sql(_LOG_FILE, events=table(spark, sf_dir, "events"))
    for lot in (0, 1):
        lines.filter(F.col("event_id") % 2 == lot).select("value").write.mode("append").text(path)
        writer = logs.split_log_stream(spark.readStream.text(path), kept, broken)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(kept), spark.read.parquet(broken)


@query("read_json_logs_stream", _LOGS_SQL)
def _(spark, sf_dir):
    return _log_counts(_split_logs(spark, sf_dir)[0])


@query("broken_log_lines_stream", _BROKEN_SQL)
def _(spark, sf_dir):
    return _split_logs(spark, sf_dir)[1].select("broken")


@query("broken_log_lines", _BROKEN_SQL)
def _(spark, sf_dir):
    lines = spark.sql(_LOG_FILE, events=table(spark, sf_dir, "events")).select("value")
    return files.broken_log_rows(files.parse_log_lines(lines))


# A model response of each event, in the shapes responses come in.
_RESPONSES = """SELECT event_id, CASE event_type
        WHEN 'click' THEN CONCAT('Here you go:\n```json\n[{{"query": "q', CAST(event_id AS STRING), '", "method": "GET"}},]\n```\nbye')
        WHEN 'view' THEN CONCAT('json {{"examples": [{{"query": "q', CAST(event_id AS STRING), '", "method": "PUT"}}, {{"query": "again"}}]}}')
        WHEN 'signup' THEN CONCAT('[{{"query": "q', CAST(event_id AS STRING), '", "method": "POST"}}, {{"query": "cut off')
        WHEN 'purchase' THEN CONCAT('[{{''query'': ''q', CAST(event_id AS STRING), ''', ''method'': ''DELETE''}}]')
        ELSE 'import json\nprint([{{"query": "no"}}])' END AS response
        FROM {events}"""


@query("salvage_json_cases", """
    SELECT event_id, CAST(0 AS BIGINT) AS case_no, 'q' || CAST(event_id AS VARCHAR) AS query,
           CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'PUT' WHEN 'signup' THEN 'POST' ELSE 'DELETE' END AS method
    FROM {events} WHERE event_type <> 'error'
    UNION ALL SELECT event_id, 1, 'again', NULL FROM {events} WHERE event_type = 'view'""")
def _(spark, sf_dir):
    raw = spark.sql(_RESPONSES, events=table(spark, sf_dir, "events"))
    found = cases.salvage_json_cases(raw, "response", ["event_id"])
    return found.select(
        "event_id", F.col("case_no").cast("bigint").alias("case_no"),
        F.try_element_at("fields", F.lit("query")).alias("query"), F.try_element_at("fields", F.lit("method")).alias("method"),
    )


@query("normalise_cases", """
    SELECT dataset_id, line_no, query, coalesce(api, 'unknown_api') AS api, coalesce(request, '{{}}') AS request,
           CASE scenario_type WHEN 'valid' THEN 'valid' WHEN 'edge_case' THEN 'edge' ELSE 'extreme' END AS scenario_type,
           CASE test_category WHEN 'typo' THEN 'typo' WHEN 'Security' THEN 'security' ELSE 'valid_flow' END AS test_category,
           CASE intent_type WHEN 'update' THEN 'update' ELSE 'create' END AS intent_type,
           CAST(coalesce(confidence_score, CASE scenario_type WHEN 'valid' THEN 0.85 WHEN 'edge_case' THEN 0.7 ELSE 0.6 END) AS DOUBLE) AS confidence_score,
           expected_response, notes
    FROM (SELECT *, '{{"status": "success"}}' AS expected_response, '' AS notes FROM {cases}) WHERE query IS NOT NULL""")
def _(spark, sf_dir):
    rows = role(spark, sf_dir, "cases").withColumn("confidence_score", F.col("confidence_score").cast("double"))
    return cases.normalise_cases(rows).select(
        "dataset_id", "line_no", "query", "api", "request", "scenario_type", "test_category", "intent_type",
        "confidence_score", "expected_response", "notes",
    )


@query("rejected_cases", "SELECT dataset_id, count(*) AS n FROM {cases} WHERE query IS NULL GROUP BY dataset_id")
def _(spark, sf_dir):
    return cases.rejected_cases(role(spark, sf_dir, "cases")).groupBy("dataset_id").agg(F.count("*").alias("n"))


@query("project_case_columns", """
    SELECT dataset_id, line_no, query, api AS api_name, request, CAST(NULL AS VARCHAR) AS response, scenario_type AS data_category, test_category AS variation_type FROM {cases}""")
def _(spark, sf_dir):
    return cases.project_case_columns(role(spark, sf_dir, "cases"), ["dataset_id", "line_no"]).drop("endpoint", "description")


@query("case_distributions", """
    SELECT 'scenario' AS kind, s AS name, (SELECT count(*) FROM {cases} WHERE scenario_type = s) AS n FROM (SELECT unnest(['valid', 'edge', 'extreme']) AS s)
    UNION ALL SELECT 'category', coalesce(test_category, 'unknown'), count(*) FROM {cases} GROUP BY 2""")
def _(spark, sf_dir):
    return cases.case_distributions(role(spark, sf_dir, "cases"))


@query("clamp_generation_params", """
    SELECT p_partkey, CASE WHEN p_size > 45 THEN 50 WHEN p_size < 5 THEN 5 ELSE least(p_size * 20, 500) END AS num_samples,
           CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END AS user_prompt,
           CAST(CASE WHEN p_type = 'PROMO' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS valid_share
    FROM {part}""")
def _(spark, sf_dir):
    promo = F.col("p_type") == "PROMO"
    size = F.col("p_size")
    params = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size > 45, None).when(size < 5, size).otherwise(size * 20).alias("num_samples"),
        F.when(~promo, F.col("p_name")).alias("user_prompt"),
        F.when(~promo, F.create_map(F.lit("valid"), F.lit(0.5), F.lit("edge"), F.lit(0.5))).alias("scenario_distribution"),
    )
    out = cases.clamp_generation_params(params)
    return out.select("p_partkey", "num_samples", "user_prompt", F.col("scenario_distribution")["valid"].alias("valid_share"))


# --- templates --------------------------------------------------------------------------

# One request schema per customer: nested object, nullable type, enum, array of objects.
_SCHEMAS = """SELECT c_custkey AS t_id, CONCAT(
        '{{"type": "object", "required": ["customer_id", "address"], "properties": {{"customer_id": {{"type": "string"}}, "segment": {{"type": ["null", "string"], "enum": ["',
        c_mktsegment, '", "OTHER"]}}, "address": {{"type": "object", "required": ["nation"], "properties": {{"nation": {{"type": "integer"}}, "geo": {{"type": "object", "properties": {{"lat": {{"type": "number"}}}}}}}}}},',
        ' "items": {{"type": "array", "items": {{"type": "object", "properties": {{"sku_', CAST(c_nationkey AS STRING), '": {{}}}}}}}}, "mail": {{"type": "string", "format": "email"}}}}}}') AS json_schema
        FROM {customer}"""


@query("schema_fields", """
    SELECT c_custkey AS t_id, i AS ordinal,
           CASE f WHEN 'items[].sku_' THEN f || CAST(c_nationkey AS VARCHAR) ELSE f END AS field,
           ['string', 'string', 'object', 'integer', 'object', 'number', 'array', 'string', 'string'][i + 1] AS type,
           CASE f WHEN 'mail' THEN 'email' END AS format, CASE f WHEN 'segment' THEN c_mktsegment || ',OTHER' END AS enum,
           f IN ('customer_id', 'address', 'address.nation') AS required
    FROM {customer}, (SELECT CAST(unnest(range(9)) AS INT) AS i, unnest(['customer_id', 'segment', 'address', 'address.nation', 'address.geo', 'address.geo.lat', 'items', 'items[].sku_', 'mail']) AS f)""")
def _(spark, sf_dir):
    rows = templates.schema_fields(spark.sql(_SCHEMAS, customer=table(spark, sf_dir, "customer")))
    return rows.withColumn("enum", F.array_join("enum", ","))


_TEMPLATE_DOCS = """SELECT c_custkey AS t_id,
        CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN REPEAT('word ', 500) ELSE ' just two ' END AS description,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'edge' ELSE 'valid' END AS scenario,
        CASE WHEN c_nationkey < 10 THEN 2 ELSE 3 END AS n_samples,
        CASE WHEN c_nationkey > 20 THEN 0 ELSE 1 END AS n_parameters,
        CASE WHEN c_nationkey = 5 THEN '{{"properties": {{}}}}' WHEN c_nationkey = 6 THEN '{{"type": "object"}}' ELSE '{{"type": "object", "properties": {{}}}}' END AS json_schema
        FROM {customer}"""


@query("validate_templates", f"""
    WITH t AS ({_TEMPLATE_DOCS})
    SELECT t_id, 'description' AS field, 'Description has only ' || (CASE WHEN description IS NULL THEN '0' ELSE '2' END) || ' words (minimum 500 required)' AS error FROM t WHERE description IS NULL OR description = ' just two '
    UNION ALL SELECT t_id, 'sample_requests', 'Only 2 sample requests (minimum 3 required)' FROM t WHERE n_samples = 2
    UNION ALL SELECT t_id, 'sample_requests', 'No sample request has scenario ''valid''' FROM t WHERE scenario = 'edge'
    UNION ALL SELECT t_id, 'parameters', 'No parameters defined (minimum 1 required)' FROM t WHERE n_parameters = 0
    UNION ALL SELECT t_id, 'domain_tags', 'No domain tags specified (minimum 1 required)' FROM t WHERE n_parameters = 0
    UNION ALL SELECT t_id, 'json_schema', 'JSON Schema missing ''type'' field' FROM t WHERE json_schema = '{{{{"properties": {{{{}}}}}}}}'
    UNION ALL SELECT t_id, 'json_schema', 'JSON Schema with type ''object'' must include ''properties''' FROM t WHERE json_schema = '{{{{"type": "object"}}}}'""")
def _(spark, sf_dir):
    docs = spark.sql(_TEMPLATE_DOCS, customer=table(spark, sf_dir, "customer"))
    sample = F.concat(F.lit('{"scenario": "'), F.col("scenario"), F.lit('"}'))
    full = docs.select(
        "t_id", "description", "n_parameters", "json_schema",
        F.array_repeat(sample, F.col("n_samples")).alias("sample_requests"),
        F.array_repeat(F.lit("{}"), 3).alias("sample_responses"),
        F.when(F.col("n_parameters") > 0, F.array(F.lit("shop"))).alias("domain_tags"),
    )
    return templates.validate_templates(full)


@query("required_parameters_missing", """
    SELECT o_orderkey AS request_id, o_custkey AS t_id,
           concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'city' END, CASE WHEN c_acctbal > 0 AND o_orderpriority < '3' THEN 'street' END) AS missing
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey""")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    params = customer.select(F.col("c_custkey").alias("t_id"), F.explode(F.array(
        F.struct(F.lit("city").alias("name"), F.lit(True).alias("is_required")),
        F.struct(F.lit("street").alias("name"), (F.col("c_acctbal") > 0).alias("is_required")),
        F.struct(F.lit("note").alias("name"), F.lit(False).alias("is_required")),
    )).alias("p")).select("t_id", "p.*")
    given = F.map_filter(
        F.create_map(
            F.lit("city"), F.when(F.col("o_orderstatus") != "O", F.lit("x")),
            F.lit("street"), F.when(F.col("o_orderpriority") >= "3", F.lit("y")),
        ),
        lambda _, v: v.isNotNull(),
    )
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("t_id"), given.alias("values"))
    out = templates.required_parameters_missing(params, requests)
    return out.withColumn("missing", F.array_join("missing", ","))


# --- the vector table ---------------------------------------------------------------------

def _vector_rows(spark, sf_dir):
    return role(spark, sf_dir, "vectors").select("row_uid", "u_id", "t_id", "dataset_id", "query", "embedding")


def _plain(vecs):
    triple = ["embedding_provider", "embedding_model", "dimension"]
    return vecs.groupBy("dataset_id", *triple, "method", "scenario_type").agg(
        F.count("*").alias("n"), F.sum("row_uid").alias("ids"), F.round(F.sum(F.col("embedding")[0].cast("double")), 6).alias("first_sum")
    )


@query("append_vectors", """
    SELECT dataset_id, 'acme' AS embedding_provider, 'm1' AS embedding_model, 64 AS dimension, 'POST' AS method, 'valid' AS scenario_type,
           count(*) AS n, CAST(sum(row_uid) AS BIGINT) AS ids, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS first_sum
    FROM {vectors} GROUP BY dataset_id""")
def _(spark, sf_dir):
    path = fresh_path(spark, "vectors")
    vectors.append_vectors(_vector_rows(spark, sf_dir), path, "acme", "m1", 64)
    return _plain(vectors.read_vectors(spark, path))


@query("replace_dataset_vectors", """
    SELECT dataset_id, 'acme' AS embedding_provider, 'm1' AS embedding_model, 64 AS dimension, CASE WHEN dataset_id < 'src2' THEN 'PUT' ELSE 'POST' END AS method,
           'valid' AS scenario_type, count(*) AS n, CAST(sum(row_uid) AS BIGINT) AS ids, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS first_sum
    FROM {vectors} GROUP BY dataset_id""")
def _(spark, sf_dir):
    path = fresh_path(spark, "vectors")
    rows = _vector_rows(spark, sf_dir)
    vectors.append_vectors(rows, path, "acme", "m1", 64)
    again = rows.filter(F.col("dataset_id") < "src2").withColumn("method", F.lit("PUT"))
    for _ in range(2):
        vectors.replace_dataset_vectors(again, path, "acme", "m1", 64)
    return _plain(vectors.read_vectors(spark, path))


@query("delete_vectors", """
    SELECT row_uid, u_id, t_id, dataset_id FROM {vectors}
    WHERE NOT (u_id = 'en' AND t_id IN (SELECT label FROM {embeddings} e JOIN {labels} l ON e.vec_id = l.doc_id WHERE l.toxic = 1))""")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("toxic = 1")
    doomed = table(spark, sf_dir, "embeddings").join(labels, F.col("vec_id") == F.col("doc_id")).select(F.col("label").cast("bigint").alias("t_id"))
    left = vectors.delete_vectors(role(spark, sf_dir, "vectors"), "en", doomed, by="t_id")
    return left.select("row_uid", "u_id", "t_id", "dataset_id")


@query("delete_dataset_cascade", """
    SELECT 'vectors' AS table_name, count(*) AS deleted FROM {vectors} WHERE u_id = 'en' AND dataset_id LIKE 'src1%'
    UNION ALL SELECT 'rows', count(*) FROM {documents} WHERE lang = 'en' AND source LIKE 'src1%'""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("u_id"), F.col("source").alias("dataset_id"))
    doomed = rows.filter(F.col("dataset_id").startswith("src1"))
    return vectors.deleted_counts({"vectors": role(spark, sf_dir, "vectors"), "rows": rows}, "en", doomed)


@query("measured_dimension", """
    SELECT s AS dataset_id, CASE WHEN n > 0 THEN 64 ELSE 32 END AS embedding_dimension, n > 0 AS retagged
    FROM (SELECT d.source AS s, count(v.row_uid) AS n FROM {documents} d LEFT JOIN {vectors} v ON v.row_uid = d.doc_id GROUP BY d.source)""")
def _(spark, sf_dir):
    recorded = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id")).distinct().withColumn("embedding_dimension", F.lit(32))
    return vectors.retag_dimension(recorded, vectors.measured_dimension(role(spark, sf_dir, "vectors")))
