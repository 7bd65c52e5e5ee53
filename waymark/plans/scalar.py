"""Column functions over the given texts, addresses and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import intent, logs, models, net, scrub, text, values
from waymark.plans.registry import query, spread_table, table

# What a log line of each event looks like; the same text is built on both engines.
LOG_LINE = """
    CASE event_type
        WHEN 'click' THEN CONCAT('Dataset generation completed: ', CAST(user_id % 10 AS STRING), ' rows')
        WHEN 'view' THEN CONCAT('GET /api/v1/items/', CAST(event_id AS STRING))
        WHEN 'signup' THEN CONCAT('User ', CAST(user_id AS STRING), ' logged in')
        WHEN 'purchase' THEN CONCAT('order ', CAST(event_id AS STRING), ' done, value ', CAST(CAST(FLOOR(value) AS BIGINT) AS STRING))
        ELSE CONCAT('Provider connection test failed for user ', CAST(user_id AS STRING)) END"""


@query("tokenize", """
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {documents}),
    runs AS (SELECT doc_id, w FROM t UNION ALL
             SELECT doc_id, r FROM (SELECT doc_id, unnest(regexp_extract_all(w, '[a-z]+|[0-9]+')) AS r FROM t
                                    WHERE regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')) WHERE length(r) > 1)
    SELECT d.doc_id, count(w) AS n_tokens, count(DISTINCT w) AS n_terms, min(w) AS first_term, max(w) AS last_term
    FROM {documents} d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf_dir):
    tokens = spread_table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))
    distinct = F.array_distinct("tokens")
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(distinct).cast("bigint").alias("n_terms"),
        F.array_min("tokens").alias("first_term"),
        F.array_max("tokens").alias("last_term"),
    )


@query("first_url", """
    WITH raw AS (SELECT page_id, rtrim(regexp_extract('see ' || url || ', thanks', '(https?://[^, ]+)', 1), '.,!?)]''"') AS u FROM {pages})
    SELECT page_id, u AS raw_url, lower(regexp_extract(u, '^[^:]*://[^/]*')) || regexp_replace(u, '^[^:]*://[^/]*', '') AS normalised FROM raw""")
def _(spark, sf_dir):
    said = F.concat(F.lit("see "), F.col("url"), F.lit(" , thanks"))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.first_url(said).alias("raw_url"), text.normalised_url(said).alias("normalised")
    )


@query("intent_from_method", """
    SELECT event_id, method, CASE method WHEN '' THEN 'unknown' WHEN 'Post' THEN 'create' WHEN 'get' THEN 'read'
                                         WHEN 'PATCH' THEN 'update' ELSE 'query' END AS intent
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'Post' WHEN 'view' THEN 'get' WHEN 'signup' THEN 'PATCH'
                                           WHEN 'purchase' THEN 'OPTIONS' ELSE '' END AS method FROM {events})""")
def _(spark, sf_dir):
    kind = F.col("event_type")
    method = (
        F.when(kind == "click", "Post").when(kind == "view", "get").when(kind == "signup", "PATCH")
        .when(kind == "purchase", "OPTIONS").otherwise("")
    )
    return (
        table(spark, sf_dir, "events").select("event_id", method.alias("method"))
        .withColumn("intent", intent.intent_from_method(F.col("method")))
    )


def _contains_sum(column: str, phrases: list[str]) -> str:
    return " + ".join(f"CAST(contains({column}, '{p}') AS INT)" for p in phrases)


_INTENT_COUNTS = ",\n".join(
    f"({_contains_sum('low', phrases)}) AS n_{name}" for name, phrases in intent.INTENT_PHRASES.items()
)
_INTENT_ORDER = list(intent.INTENT_PHRASES)
_INTENT_CASE = " ".join(f"WHEN n_{name} = best THEN '{name}'" for name in _INTENT_ORDER)
_INTENT_BEST = "greatest(" + ", ".join(f"n_{name}" for name in _INTENT_ORDER) + ")"


def _intent_oracle(source: str, key: str) -> str:
    return f"""
    WITH counts AS (SELECT {key}, body, {_INTENT_COUNTS} FROM (SELECT {key}, text AS body, lower(text) AS low FROM {source})),
    top AS (SELECT *, {_INTENT_BEST} AS best FROM counts)
    SELECT {key}, CASE WHEN body = '' OR best = 0 THEN 'unknown' {_INTENT_CASE} END AS intent,
           CAST(CASE WHEN body = '' THEN 0.0 WHEN best = 0 THEN 0.5 WHEN best >= 3 THEN 0.95 WHEN best = 2 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence
    FROM top"""


@query("intent_from_text", _intent_oracle("{documents}", "doc_id"))
def _(spark, sf_dir):
    found = intent.intent_from_text(F.col("text"))
    return spread_table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.intent", "f.confidence")


@query("intent_for_row", f"""
    WITH guess AS ({_intent_oracle("{documents}", "doc_id")}),
    base AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'GET' WHEN 'de' THEN 'DELETE' ELSE NULL END AS method,
                    CASE lang WHEN 'fr' THEN 'extreme' WHEN 'en' THEN 'extreme' ELSE 'valid' END AS scenario FROM {{documents}})
    SELECT doc_id, CASE WHEN method = 'GET' THEN 'read' WHEN method = 'DELETE' THEN 'delete'
                        WHEN scenario = 'extreme' THEN (CASE WHEN confidence < 0.7 THEN 'unknown' ELSE intent END)
                        ELSE 'unknown' END AS intent
    FROM base JOIN guess USING (doc_id)""")
def _(spark, sf_dir):
    lang = F.col("lang")
    method = F.when(lang == "en", "GET").when(lang == "de", "DELETE")
    scenario = F.when(lang.isin("fr", "en"), "extreme").otherwise("valid")
    return spread_table(spark, sf_dir, "documents").select(
        "doc_id", intent.intent_for_row(F.col("text"), method, scenario).alias("intent")
    )


# Secrets are put around the whole given text.
SECRET_TEXT = """CONCAT(text, ' Bearer abc.def-', CAST(doc_id AS STRING), '== tail password = s3cr3t', CAST(doc_id AS STRING),
    '&next api_key=K', CAST(doc_id AS STRING), ' db postgresql+asyncpg://app:pw', CAST(doc_id AS STRING), '@db/x eyJhbGci.eyJz.c2ln')"""


@query("scrub_text", f"""
    SELECT doc_id, length(clean) AS n_chars, md5(clean) AS digest FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SECRET_TEXT},
          '(?i)bearer\\s+[a-z0-9\\-._~+/]+=*', '***REDACTED***', 'g'),
          'eyJ[A-Za-z0-9\\-_]+\\.[A-Za-z0-9\\-_]+\\.[A-Za-z0-9\\-_]+', '***REDACTED***', 'g'),
          '(?i)(postgresql(?:\\+[a-z0-9_]+)?://[^:]+:)[^@]+@', '\\1***REDACTED***@', 'g'),
          '(?i)password\\s*=\\s*[^\\s&"'']+', '***REDACTED***', 'g'),
          '(?i)api[_-]?key\\s*=\\s*[^\\s&"'']+', '***REDACTED***', 'g') AS clean FROM {{documents}})""")
def _(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.expr(SECRET_TEXT).alias("line"))
    clean = docs.select("doc_id", scrub.scrub_text(F.col("line")).alias("clean"))
    return clean.select("doc_id", F.length("clean").cast("bigint").alias("n_chars"), F.md5(F.col("clean").cast("binary")).alias("digest"))


@query("scrub_fields", """
    SELECT event_id, field, CASE WHEN field = 'API_KEY' THEN '***REDACTED***' WHEN field = 'client_ip' THEN '***PII***'
                                 WHEN field = 'query' AND length(v) > 200 THEN substr(v, 1, 200) || '...[truncated ' || CAST(length(v) - 200 AS VARCHAR) || ' chars]'
                                 WHEN field = 'note' THEN '***REDACTED*** for ' || CAST(user_id AS VARCHAR) ELSE v END AS value
    FROM (SELECT event_id, user_id, unnest(['API_KEY', 'client_ip', 'query', 'note', 'kind']) AS field,
                 unnest([props, '10.0.0.' || CAST(user_id AS VARCHAR), repeat('k' || CAST(event_id AS VARCHAR), 40),
                         'password=' || CAST(event_id AS VARCHAR) || ' for ' || CAST(user_id AS VARCHAR), event_type]) AS v FROM {events})""")
def _(spark, sf_dir):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    fields = F.create_map(
        F.lit("API_KEY"), F.col("props"),
        F.lit("client_ip"), F.concat(F.lit("10.0.0."), user),
        F.lit("query"), F.repeat(F.concat(F.lit("k"), event), 40),
        F.lit("note"), F.concat(F.lit("password="), event, F.lit(" for "), user),
        F.lit("kind"), F.col("event_type"),
    )
    events = spread_table(spark, sf_dir, "events")
    return events.select("event_id", F.explode(scrub.scrub_fields(fields)).alias("field", "value"))


@query("scrub_json", """
    SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"auth":"***REDACTED***","who":{"email":"***PII***","kind":"' || event_type || '"}}}}' AS clean
    FROM {events}""")
def _(spark, sf_dir):
    doc = F.concat(
        F.regexp_replace("props", r"\}$", ""), F.lit(', "auth": "a'), F.col("event_id").cast("string"),
        F.lit('", "who": {"email": "x@y.z", "kind": "'), F.col("event_type"), F.lit('"}}'),
    )
    return spread_table(spark, sf_dir, "events").select("event_id", scrub.scrub_json(doc).alias("clean"))


@query("normalise_path", """
    SELECT page_id, regexp_replace(url || '/0a1b2c3d-' || CAST(page_id AS VARCHAR) || '/end', '/[0-9a-f-]{{8,}}', '/{{id}}', 'g') AS path FROM {pages}""")
def _(spark, sf_dir):
    path = F.concat(F.col("url"), F.lit("/0a1b2c3d-"), F.col("page_id").cast("string"), F.lit("/end"))
    return table(spark, sf_dir, "pages").select("page_id", text.normalise_path(path).alias("path"))


@query("strip_ansi", """SELECT event_id, event_type || ' took ' || CAST(user_id AS VARCHAR) AS message FROM {events}""")
def _(spark, sf_dir):
    esc = "\x1b"
    coloured = F.concat(
        F.lit(f"{esc}[1;31m"), F.col("event_type"), F.lit(f"{esc}[0m took {esc}[38;5;12m"), F.col("user_id").cast("string"), F.lit(f"{esc}[K{esc}M"),
    )
    return table(spark, sf_dir, "events").select("event_id", text.strip_ansi(coloured).alias("message"))


@query("classify_log", f"""
    SELECT event_id,
           CASE event_type WHEN 'click' THEN '✅ Dataset generated successfully with ' || CAST(user_id % 10 AS VARCHAR) || ' examples'
                           WHEN 'signup' THEN '👋 Welcome! You are now logged in.' WHEN 'error' THEN '❌ LLM provider connection failed'
                           ELSE {LOG_LINE} END AS human_message,
           CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'success' END AS category,
           CASE event_type WHEN 'error' THEN 'high' ELSE 'normal' END AS severity,
           CASE event_type WHEN 'click' THEN 'dataset' WHEN 'signup' THEN 'auth' WHEN 'error' THEN 'llm' WHEN 'view' THEN 'api' ELSE 'system' END AS activity_type,
           event_type IN ('click', 'signup', 'error') AS matched
    FROM {{events}}""")
def _(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "events").select("event_id", F.expr(LOG_LINE).alias("message"))
    return lines.select("event_id", logs.classify_log(F.col("message")).alias("c")).select("event_id", "c.*")


def _words_case(table_, default):
    parts = []
    for name, words in table_:
        parts.append("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{name}'")
    return "CASE " + " ".join(parts) + f" {default} END"


_API_CASE = "WHEN contains(low, '/api/') OR regexp_matches(low, '^(get |post |put |delete )') THEN 'api' ELSE 'system'"


@query("infer_log_kind", f"""
    SELECT doc_id, {_words_case(logs.CATEGORY_WORDS, "ELSE 'info'")} AS category,
           {_words_case(logs.ACTIVITY_WORDS, _API_CASE)} AS activity_type
    FROM (SELECT doc_id, lower(text) AS low FROM {{documents}})""")
def _(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select(
        "doc_id", logs.infer_category(F.col("text")).alias("category"), logs.infer_activity(F.col("text")).alias("activity_type")
    )


_LISTED = """SELECT p_partkey,
        CASE WHEN p_size > 45 THEN CONCAT(p_name, ' Embed') WHEN p_size > 40 THEN CONCAT(p_name, '-Rerank') ELSE p_name END AS model_id,
        CASE p_type WHEN 'PROMO' THEN 'Chat' WHEN 'SMALL' THEN 'embedding' WHEN 'LARGE' THEN 'image' ELSE NULL END AS listed_type,
        CASE WHEN p_brand < 'Brand#13' THEN 'text' WHEN p_brand < 'Brand#15' THEN 'embeddings' WHEN p_brand < 'Brand#17' THEN 'image' ELSE NULL END AS output
        FROM {part}"""


@query("classify_model", f"""
    SELECT p_partkey, CASE WHEN listed_type = 'embedding' THEN 'embedding' WHEN listed_type = 'image' THEN NULL
                WHEN output = 'embeddings' THEN 'embedding'
                WHEN output IS NOT NULL THEN (CASE WHEN output = 'text' AND model_id NOT LIKE '%Rerank' THEN 'llm' END)
                WHEN listed_type = 'Chat' THEN (CASE WHEN model_id NOT LIKE '%Rerank' THEN 'llm' END)
                WHEN model_id LIKE '%Embed' THEN 'embedding' WHEN model_id LIKE '%Rerank' THEN NULL ELSE 'llm' END AS kind
    FROM ({_LISTED})""")
def _(spark, sf_dir):
    listed = spark.sql(_LISTED, part=table(spark, sf_dir, "part"))
    outputs = F.when(F.col("output").isNotNull(), F.array("output"))
    return listed.select("p_partkey", models.classify_model(F.col("model_id"), F.col("listed_type"), outputs).alias("kind"))


@query("model_pricing", """
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_size <= 10 THEN TRUE ELSE FALSE END AS is_free,
           CASE WHEN p_size > 30 THEN NULL ELSE DATE '2024-06-30' + INTERVAL '1' MONTH * p_size END::DATE AS shutdown_date
    FROM (SELECT p_partkey, p_type, p_size, p_size AS s FROM {part})""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    zero = F.col("p_size") <= 10
    prices = F.when(F.col("p_type") == "PROMO", F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))).otherwise(
        F.array(F.lit("0"), F.when(zero, F.lit("0.0")).otherwise(F.col("p_retailprice").cast("string")))
    )
    # sizes over 30 stand for listings that mean "no end date" by a far-away one
    until = F.when(F.col("p_size") > 30, F.lit("2098-12-31").cast("date")).otherwise(
        F.add_months(F.lit("2024-06-30").cast("date"), F.col("p_size"))
    )
    return part.select(
        "p_partkey", models.is_free(prices).alias("is_free"),
        models.end_date(until, F.lit("2024-01-01").cast("date")).alias("shutdown_date"),
    )


_PEERS = """SELECT event_id,
        CASE event_type WHEN 'click' THEN CONCAT('10.2.3.', CAST(user_id AS STRING)) WHEN 'view' THEN CONCAT('172.31.0.', CAST(user_id AS STRING))
                        WHEN 'signup' THEN CONCAT('172.32.0.', CAST(user_id AS STRING)) WHEN 'purchase' THEN '::1' ELSE NULL END AS peer,
        CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN ' , 1.1.1.1' ELSE CONCAT(' 203.0.113.', CAST(user_id AS STRING), ' , 10.0.0.1') END AS forwarded
        FROM {events}"""


@query("client_ip", f"""
    SELECT event_id, CASE WHEN forwarded IS NOT NULL AND trim(split_part(forwarded, ',', 1)) <> ''
                               AND (peer LIKE '10.%' OR peer LIKE '172.31.%' OR peer = '::1')
                          THEN trim(split_part(forwarded, ',', 1)) ELSE coalesce(peer, 'unknown') END AS client
    FROM ({_PEERS})""")
def _(spark, sf_dir):
    peers = spark.sql(_PEERS, events=table(spark, sf_dir, "events"))
    return peers.select("event_id", net.client_ip(F.col("forwarded"), F.col("peer")).alias("client"))


_PAIRS = """SELECT o_orderkey,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'enabled' WHEN '2-HIGH' THEN 'amount' WHEN '3-MEDIUM' THEN 'user_email'
                             WHEN '4-NOT SPECIFIED' THEN 'reason' ELSE 'order_id' END AS field,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'boolean' WHEN '2-HIGH' THEN 'number' ELSE 'string' END AS field_type,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'true' WHEN '2-HIGH' THEN CAST(o_custkey AS STRING) WHEN '3-MEDIUM' THEN CONCAT('C', CAST(o_custkey AS STRING), '@Shop.io')
                             WHEN '4-NOT SPECIFIED' THEN 'Parcel was damaged!' ELSE CONCAT('ord_', CAST(o_custkey AS STRING)) END AS expected,
        CASE o_orderpriority WHEN '1-URGENT' THEN (CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END)
                             WHEN '2-HIGH' THEN (CASE WHEN o_orderstatus = 'O' THEN CONCAT(CAST(o_custkey AS STRING), '.0') WHEN o_orderstatus = 'P' THEN 'many' ELSE '-1' END)
                             WHEN '3-MEDIUM' THEN CONCAT(' c', CAST(o_custkey AS STRING), '@shop.io ')
                             WHEN '4-NOT SPECIFIED' THEN (CASE WHEN o_orderstatus = 'O' THEN 'the parcel was damaged' WHEN o_orderstatus = 'P' THEN 'parcel' ELSE '?!' END)
                             ELSE (CASE WHEN o_orderstatus = 'O' THEN CONCAT(' ord_', CAST(o_custkey AS STRING)) ELSE CONCAT('ORD_', CAST(o_custkey AS STRING)) END) END AS got
        FROM {orders}"""


@query("loose_match", """
    SELECT o_orderkey, (o_orderpriority = '3-MEDIUM' OR o_orderstatus = 'O') AS same FROM {orders}""")
def _(spark, sf_dir):
    pairs = spark.sql(_PAIRS, orders=table(spark, sf_dir, "orders"))
    c = F.col
    return pairs.select("o_orderkey", values.loose_match(c("field"), c("field_type"), c("expected"), c("got")).alias("same"))


_TYPED = """SELECT event_id, CASE event_type WHEN 'click' THEN 'integer' WHEN 'view' THEN 'number' WHEN 'signup' THEN 'boolean' WHEN 'purchase' THEN 'string' ELSE 'array' END AS field_type,
        CASE WHEN value > 100 THEN event_type WHEN event_type = 'click' THEN CAST(user_id AS STRING) WHEN event_type = 'view' THEN CONCAT(CAST(user_id AS STRING), '.5')
             WHEN event_type = 'signup' THEN 'TRUE' WHEN event_type = 'purchase' THEN 'x' ELSE '["a"]' END AS raw FROM {events}"""


@query("typed_coerce", f"""
    SELECT event_id, CASE WHEN raw = 'TRUE' THEN 'true' ELSE raw END AS value,
           CASE WHEN raw IN ('click', 'view', 'signup', 'error') THEN 'not a valid ' || field_type END AS problem FROM ({_TYPED})""")
def _(spark, sf_dir):
    typed = spark.sql(_TYPED, events=table(spark, sf_dir, "events"))
    return typed.select("event_id", values.typed_coerce(F.col("raw"), F.col("field_type")).alias("c")).select("event_id", "c.*")


@query("is_absent", """
    SELECT p_partkey, (p_type IN ('PROMO', 'SMALL') OR p_size < 3) AS absent FROM {part}""")
def _(spark, sf_dir):
    value = (
        F.when(F.col("p_size") < 3, None).when(F.col("p_type") == "PROMO", " N/A ").when(F.col("p_type") == "SMALL", "Not Provided")
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", values.is_absent(value).alias("absent"))


@query("classify_error", f"""
    SELECT doc_id, {_words_case(values.ERROR_WORDS, "ELSE 'unknown'")} AS category FROM (SELECT doc_id, lower(text) AS low FROM {{documents}})""")
def _(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select("doc_id", values.classify_error(F.col("text")).alias("category"))


@query("parse_json_or_raw", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN json_object('raw', event_type || ' {{' || CAST(user_id AS VARCHAR)) ELSE props END AS parsed
    FROM {events}""")
def _(spark, sf_dir):
    kind = F.col("event_type")
    raw = F.when(kind == "view", None).when(kind == "error", F.concat(kind, F.lit(" {"), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", values.parse_json_or_raw(raw).alias("parsed"))
