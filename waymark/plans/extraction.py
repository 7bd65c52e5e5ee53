"""Field extraction from requests composed of the orders table's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from waymark.operators import evaluation, extraction
from waymark.plans.registry import query, table
from waymark.session import spread_rows

PART_ROWS = 25_000  # requests of one task: the rules take about half a millisecond each

# One template per order priority.
_SCHEMAS = {
    "1-URGENT": ("refund_order", "/v1/refunds", '{"type": "object", "required": ["order_id", "reason"], "properties": {"order_id": {"type": "string"}, "amount": {"type": "number"}, "reason": {"type": "string"}}}'),
    "2-HIGH": ("invite_user", "/v1/invites", '{"type": "object", "required": ["email", "role"], "properties": {"email": {"type": "string", "format": "email"}, "role": {"type": "string", "enum": ["admin", "viewer", "editor"]}, "notify_enabled": {"type": "boolean"}}}'),
    "3-MEDIUM": ("change_password", "/v1/password", '{"type": "object", "required": ["current_password", "new_password"], "properties": {"current_password": {"type": "string"}, "new_password": {"type": "string"}}}'),
    "4-NOT SPECIFIED": ("list_items", "/v1/items", '{"type": "object", "required": ["page"], "properties": {"page": {"type": "integer"}, "limit": {"type": "integer"}, "session_token": {"type": "string"}}}'),
    "5-LOW": ("update_profile", "/v1/users", '{"type": "object", "required": ["user_id"], "properties": {"user_id": {"type": "string"}, "timezone": {"type": ["string", "null"]}, "currency": {"type": "string"}}}'),
}

_TEXTS = """SELECT o_orderkey AS request_id, o_orderpriority AS t_id, o_orderstatus AS st, o_custkey AS ck, o_totalprice AS price, CASE o_orderpriority
        WHEN '1-URGENT' THEN CONCAT('Refund $', CAST(o_totalprice AS STRING), ' on order ORD-', CAST(o_orderkey AS STRING), ' because the box was torn')
        WHEN '2-HIGH' THEN CONCAT('Invite User', CAST(o_custkey AS STRING), '@Shop', CAST(o_orderkey AS STRING), '.example.com as ', CASE o_orderstatus WHEN 'O' THEN 'Editor and notify them' WHEN 'P' THEN 'editor or viewer' ELSE 'editor' END)
        WHEN '3-MEDIUM' THEN CONCAT('my current password is Old#', CAST(o_custkey AS STRING), ', the new password: Fresh_', CAST(o_orderkey AS STRING), '!')
        WHEN '4-NOT SPECIFIED' THEN CONCAT('list page ', CAST(o_custkey AS STRING), CASE WHEN o_orderstatus = 'O' THEN '' ELSE CONCAT(' limit ', CAST(o_orderkey AS STRING)) END, ' with Zx', CAST(o_orderkey AS STRING), '#!?')
        ELSE CONCAT('User u_', CAST(o_custkey AS STRING), ' moved to Europe/Paris and pays in ', CASE WHEN o_orderstatus = 'F' THEN 'EUR or USD' ELSE 'EUR' END) END AS text
        FROM {orders}"""

# What the rules must find, known from how the texts are put together.
RULES_SQL = f"""
    SELECT request_id, t_id, unnest(f) AS field, unnest(v) AS value FROM (
      SELECT *, CASE t_id WHEN '1-URGENT' THEN ['order_id', 'amount'] WHEN '2-HIGH' THEN ['email', 'role'] WHEN '3-MEDIUM' THEN ['current_password', 'new_password']
                          WHEN '4-NOT SPECIFIED' THEN ['page', 'limit'] ELSE ['user_id', 'timezone', 'currency'] END AS f,
             CASE t_id WHEN '1-URGENT' THEN ['ORD-' || request_id, CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END]
                       WHEN '2-HIGH' THEN ['User' || ck || '@Shop' || request_id || '.example.com', CASE WHEN st <> 'P' THEN 'editor' END]
                       WHEN '3-MEDIUM' THEN ['Old#' || ck, 'Fresh_' || request_id || '!']
                       WHEN '4-NOT SPECIFIED' THEN [CAST(ck AS VARCHAR), CASE WHEN st <> 'O' THEN CAST(request_id AS VARCHAR) END]
                       ELSE ['u_' || ck, 'Europe/Paris', CASE WHEN st <> 'F' THEN 'EUR' END] END AS v
      FROM ({_TEXTS}))"""
FOUND_SQL = f"SELECT * FROM ({RULES_SQL}) WHERE value IS NOT NULL"

# Proposed values, and the verdict on each, by construction.
_PROPOSALS = """SELECT o_orderkey AS request_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'reason' WHEN '2-HIGH' THEN (CASE WHEN o_orderstatus = 'P' THEN 'role' ELSE 'notify_enabled' END)
             WHEN '4-NOT SPECIFIED' THEN (CASE WHEN o_orderstatus = 'O' THEN 'limit' ELSE 'session_token' END) ELSE 'currency' END AS field,
        CASE o_orderpriority WHEN '1-URGENT' THEN (CASE WHEN o_orderstatus = 'O' THEN 'Reason: the box was torn' WHEN o_orderstatus = 'P' THEN 'order saying the box was torn' WHEN o_custkey < 700 THEN 'customer unhappy' ELSE 'refund' END)
             WHEN '2-HIGH' THEN (CASE WHEN o_orderstatus <> 'P' THEN 'true' WHEN o_custkey < 400 THEN 'owner' WHEN o_custkey < 800 THEN 'admin' ELSE 'viewer' END)
             WHEN '4-NOT SPECIFIED' THEN (CASE WHEN o_orderstatus = 'O' THEN '999999999' ELSE CONCAT('Zx', CAST(o_orderkey AS STRING)) END)
             ELSE (CASE WHEN o_custkey < 500 THEN 'none' ELSE 'usd' END) END AS value
        FROM {orders} WHERE o_orderpriority <> '3-MEDIUM'"""
JUDGED_SQL = """
    SELECT o_orderkey AS request_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'reason' WHEN '2-HIGH' THEN (CASE WHEN o_orderstatus = 'P' THEN 'role' ELSE 'notify_enabled' END)
             WHEN '4-NOT SPECIFIED' THEN (CASE WHEN o_orderstatus = 'O' THEN 'limit' ELSE 'session_token' END) ELSE 'currency' END AS field,
        CASE o_orderpriority WHEN '1-URGENT' THEN (CASE WHEN o_orderstatus <> 'F' THEN 'the box was torn' WHEN o_custkey < 700 THEN 'customer unhappy' ELSE 'refund' END)
             WHEN '2-HIGH' THEN (CASE WHEN o_orderstatus <> 'P' THEN 'true' WHEN o_custkey < 400 THEN 'owner' WHEN o_custkey < 800 THEN 'admin' ELSE 'viewer' END)
             WHEN '4-NOT SPECIFIED' THEN (CASE WHEN o_orderstatus = 'O' THEN '999999999' ELSE 'Zx' || CAST(o_orderkey AS VARCHAR) || '#!' END) ELSE 'usd' END AS value,
        CAST(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P' THEN 0.7 ELSE 0.85 END AS DOUBLE) AS confidence,
        CASE o_orderpriority WHEN '1-URGENT' THEN (CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_custkey < 700 THEN 'not in the request' ELSE 'only repeats the command' END)
             WHEN '2-HIGH' THEN (CASE WHEN o_orderstatus <> 'P' THEN NULL WHEN o_custkey < 400 THEN 'not one of [''admin'', ''viewer'', ''editor'']' WHEN o_custkey < 800 THEN 'inferred, not stated' END)
             WHEN '4-NOT SPECIFIED' THEN (CASE WHEN o_orderstatus = 'O' THEN 'that number is not in the request' END) END AS problem
    FROM {orders} WHERE o_orderpriority <> '3-MEDIUM' AND NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')
      AND NOT (o_orderpriority = '5-LOW' AND (o_orderstatus <> 'F' OR o_custkey < 500))"""


def catalogue(spark):
    rows = [(t, name, endpoint, schema) for t, (name, endpoint, schema) in _SCHEMAS.items()]
    return spark.createDataFrame(rows, "t_id string, api_name string, endpoint string, json_schema string")


def requests(spark, sf_dir):
    return spark.sql(_TEXTS, orders=spread_rows(table(spark, sf_dir, "orders"), PART_ROWS, "o_orderkey"))


def extracted(spark, sf_dir):
    return extraction.extract_by_rules(requests(spark, sf_dir).select("request_id", "t_id", "text"), catalogue(spark))


def proposals(spark, sf_dir):
    return spark.sql(_PROPOSALS, orders=table(spark, sf_dir, "orders"))


def judged(spark, sf_dir):
    return extraction.ground_proposals(extracted(spark, sf_dir), proposals(spark, sf_dir))


@query("extract_by_rules", f"SELECT request_id, field, value, 'rule' AS source, CAST(0.99 AS DOUBLE) AS confidence FROM ({FOUND_SQL})")
def _(spark, sf_dir):
    return extraction.rule_rows(extracted(spark, sf_dir))


def _phase_query(name: str, fields: str, wanted: str):
    """One phase alone over the whole table of requests."""

    @query(name, f"SELECT request_id, field, value FROM ({FOUND_SQL}) WHERE {wanted}")
    def _(spark, sf_dir):
        df = extraction.with_fields(requests(spark, sf_dir), catalogue(spark))
        empty = F.array().cast(f"array<{extraction.CLAIM}>")
        phase = getattr(extraction, name)
        found = df.select("request_id", F.explode(phase(F.col("text"), F.col("fields"), empty)).alias("c"))
        return found.select("request_id", "c.field", "c.value")


_phase_query("extract_emails", "email", "field = 'email'")
_phase_query("extract_identifiers", "ids", "field IN ('order_id', 'user_id')")
_phase_query("extract_secrets", "secrets", "field IN ('current_password', 'new_password')")
_phase_query("extract_enums", "enum", "field = 'role'")
_phase_query("extract_formats", "formats", "field IN ('timezone', 'currency')")
_phase_query("extract_named_numbers", "numbers", "field IN ('page', 'limit')")
_phase_query("extract_last_number", "number", "field = 'amount'")


@query("claimed_spans_disjoint", f"SELECT count(DISTINCT request_id) AS requests, count(*) AS n_claims, CAST(0 AS BIGINT) AS overlaps FROM ({FOUND_SQL})")
def _(spark, sf_dir):
    claims = extracted(spark, sf_dir)
    clash = F.exists("claims", lambda a: F.exists("claims", lambda b: (a["field"] != b["field"]) & (a["s"] < b["e"]) & (b["s"] < a["e"])))
    return claims.agg(
        F.count_distinct(F.when(F.size("claims") > 0, F.col("request_id"))).alias("requests"), F.sum(F.size("claims")).alias("n_claims"), F.count_if(clash).alias("overlaps")
    )


_COMMAND = """CASE t_id WHEN '1-URGENT' THEN ['refund', 'order', 'v1', 'refunds', 'id', 'amount', 'reason'] WHEN '2-HIGH' THEN ['invite', 'user', 'v1', 'invites', 'email', 'role', 'notify', 'enabled']
        WHEN '3-MEDIUM' THEN ['change', 'password', 'v1', 'current', 'new'] WHEN '4-NOT SPECIFIED' THEN ['list', 'items', 'v1', 'page', 'limit', 'session', 'token']
        ELSE ['update', 'profile', 'v1', 'users', 'user', 'id', 'timezone', 'currency'] END"""
_STOP = "[" + ", ".join(f"'{w}'" for w in extraction.STOPWORDS) + "]"


@query("unexplained_words", f"""
    WITH t AS (SELECT request_id, t_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM ({_TEXTS})),
    f AS (SELECT DISTINCT request_id, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS w FROM ({FOUND_SQL}))
    SELECT r.request_id, coalesce(string_agg(x.w, ' ' ORDER BY x.w), '') AS words FROM ({_TEXTS}) r LEFT JOIN
      (SELECT t.request_id, t.w FROM t ANTI JOIN f ON f.request_id = t.request_id AND f.w = t.w WHERE NOT list_contains({_COMMAND}, t.w) AND NOT list_contains({_STOP}, t.w)) x USING (request_id) GROUP BY 1""")
def _(spark, sf_dir):
    df = extraction.with_command(extracted(spark, sf_dir))
    return df.select("request_id", F.array_join(extraction.unexplained_words(F.col("text"), F.col("command")), " ").alias("words"))


@query("ground_proposals", JUDGED_SQL)
def _(spark, sf_dir):
    return judged(spark, sf_dir)


@query("refine_proposals", f"SELECT request_id, field, value FROM ({JUDGED_SQL}) WHERE field IN ('reason', 'session_token')")
def _(spark, sf_dir):
    return judged(spark, sf_dir).filter(F.col("field").isin("reason", "session_token")).select("request_id", "field", "value")


_REQUIRED = """SELECT request_id, unnest(CASE t_id WHEN '1-URGENT' THEN ['order_id', 'reason'] WHEN '2-HIGH' THEN ['email', 'role'] WHEN '3-MEDIUM' THEN ['current_password', 'new_password']
        WHEN '4-NOT SPECIFIED' THEN ['page'] ELSE ['user_id'] END) AS field FROM r"""


@query("assemble_extraction", f"""
    WITH r AS ({_TEXTS}), j AS ({JUDGED_SQL}),
    good AS (SELECT request_id, field, value, 0.99 AS confidence FROM ({FOUND_SQL}) UNION ALL SELECT request_id, field, value, confidence FROM j WHERE problem IS NULL),
    miss AS (SELECT q.request_id, q.field FROM ({_REQUIRED}) q ANTI JOIN good g ON g.request_id = q.request_id AND g.field = q.field),
    g AS (SELECT request_id, string_agg(field || '=' || value, ';' ORDER BY field) AS vals, min(confidence) AS confidence FROM good GROUP BY 1),
    m AS (SELECT request_id, string_agg(field, ',' ORDER BY field) AS missing FROM miss GROUP BY 1),
    u AS (SELECT request_id, string_agg(field || ': ' || problem, ';') AS unverified FROM j WHERE problem IS NOT NULL GROUP BY 1)
    SELECT r.request_id, g.vals AS "values", CAST(g.confidence AS DOUBLE) AS confidence, coalesce(m.missing, '') AS missing_required, coalesce(u.unverified, '') AS unverified, m.missing IS NULL AS ok,
           CASE WHEN r.request_id IN (SELECT request_id FROM j) THEN 'hybrid' ELSE 'rules' END AS strategy
    FROM r LEFT JOIN g USING (request_id) LEFT JOIN m USING (request_id) LEFT JOIN u USING (request_id)""")
def _(spark, sf_dir):
    out = extraction.assemble_extraction(extracted(spark, sf_dir), proposals(spark, sf_dir))
    pairs = F.array_sort(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select(
        "request_id", F.array_join(pairs, ";").alias("values"), "confidence", F.array_join(F.array_sort("missing_required"), ",").alias("missing_required"),
        F.array_join(F.transform("unverified", lambda u: F.concat(u["field"], F.lit(": "), u["reason"])), ";").alias("unverified"), "ok", "strategy",
    )


@query("extraction_sources", f"""
    WITH j AS ({JUDGED_SQL})
    SELECT 'hybrid' AS strategy, request_id, field, value, 'rule' AS source, CAST(0.99 AS DOUBLE) AS confidence FROM ({FOUND_SQL})
    UNION ALL SELECT 'hybrid', request_id, field, value, 'proposal', confidence FROM j WHERE problem IS NULL
    UNION ALL SELECT 'rules', request_id, field, value, 'rule', CAST(0.99 AS DOUBLE) FROM ({FOUND_SQL})
    UNION ALL SELECT 'proposals', request_id, field, value, 'proposal', NULL FROM ({_PROPOSALS.replace("THEN 'none'", "THEN NULL")}) WHERE value IS NOT NULL""")
def _(spark, sf_dir):
    """Where each value of a request comes from and how sure it is, by the three strategies."""
    parts = [extraction.assemble_extraction(extracted(spark, sf_dir), proposals(spark, sf_dir), s) for s in extraction.STRATEGIES]
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("strategy", "request_id", F.explode_outer("fields").alias("field", "f")) for p in parts])
    return rows.filter("field IS NOT NULL").select("strategy", "request_id", "field", "f.value", "f.source", "f.confidence")


_BODIES = """SELECT o_orderkey AS request_id, o_orderpriority AS t_id, o_orderstatus AS st, CAST(o_custkey AS STRING) AS a,
        CASE o_orderstatus WHEN 'O' THEN '7' WHEN 'P' THEN 'N/A' ELSE 'seven' END AS b FROM {orders}"""


@query("validate_bodies", """
    SELECT o_orderkey AS request_id,
        CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN o_orderstatus <> 'F' WHEN '5-LOW' THEN o_orderstatus <> 'P' ELSE FALSE END AS ok,
        CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN (CASE o_orderstatus WHEN 'O' THEN 'limit=7;' WHEN 'F' THEN 'limit=seven;' ELSE '' END) || 'page=' || CAST(o_custkey AS VARCHAR)
             WHEN '5-LOW' THEN (CASE o_orderstatus WHEN 'O' THEN 'user_id=7' WHEN 'F' THEN 'user_id=seven' ELSE '' END) ELSE '' END AS "values",
        CASE o_orderpriority WHEN '1-URGENT' THEN 'order_id,reason' WHEN '2-HIGH' THEN 'email,role' WHEN '3-MEDIUM' THEN 'current_password,new_password'
             WHEN '5-LOW' THEN (CASE WHEN o_orderstatus = 'P' THEN 'user_id' ELSE '' END) ELSE '' END AS missing_required,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'limit: not a valid integer' ELSE '' END AS problems
    FROM {orders}""")
def _(spark, sf_dir):
    rows = spark.sql(_BODIES, orders=table(spark, sf_dir, "orders"))
    body = F.create_map(F.lit("page"), F.col("a"), F.lit("limit"), F.col("b"), F.lit("user_id"), F.col("b"), F.lit("stray"), F.lit("x"))
    out = extraction.validate_bodies(rows.select("request_id", "t_id", body.alias("body")), catalogue(spark))
    pairs = F.array_sort(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select(
        "request_id", "ok", F.array_join(pairs, ";").alias("values"), F.array_join(F.array_sort("missing_required"), ",").alias("missing_required"),
        F.array_join("problems", ";").alias("problems"),
    )




def _score_inputs(spark, sf_dir):
    """Expected: what the rules find, except a withheld time zone and a page labelled one higher."""
    rows = extraction.rule_rows(extracted(spark, sf_dir)).join(requests(spark, sf_dir).select("request_id", "ck", "st"), "request_id")
    kind = F.when(F.col("field") == "amount", "number").when(F.col("field").isin("page", "limit"), "integer").otherwise("string")
    bumped = F.when((F.col("field") == "page") & (F.col("st") == "P"), (F.col("value").cast("bigint") + 1).cast("string")).otherwise(F.col("value"))
    withheld = (F.col("field") == "timezone") & (F.col("ck") < 300)
    expected = rows.select(
        F.col("request_id").alias("case_id"), F.when(~withheld, F.col("field")).alias("field"), kind.alias("field_type"), bumped.alias("expected")
    )
    got = rows.filter(~((F.col("field") == "email") & (F.col("ck") < 300))).select(F.col("request_id").alias("case_id"), "field", F.col("value").alias("got"))
    return expected, got


SCORE_SQL = f"""
    SELECT request_id AS case_id, count(*) FILTER (NOT lost AND NOT extra AND NOT off) AS correct, count(*) FILTER (off) AS wrong, count(*) FILTER (extra) AS invented,
           count(*) FILTER (lost) AS missed, count(*) FILTER (NOT extra) AS gold, count(*) FILTER (lost OR extra OR off) = 0 AS exact
    FROM (SELECT f.request_id, field = 'email' AND ck < 300 AS lost, field = 'timezone' AND ck < 300 AS extra, field = 'page' AND st = 'P' AS off
          FROM ({FOUND_SQL}) f JOIN ({_TEXTS}) t ON t.request_id = f.request_id) GROUP BY 1"""


@query("extraction_score", SCORE_SQL)
def _(spark, sf_dir):
    return evaluation.extraction_score(*_score_inputs(spark, sf_dir))


@query("extraction_summary", f"""
    SELECT round(sum(correct) / sum(correct + wrong + invented), 6) AS precision, round(sum(correct) / sum(gold), 6) AS recall, round(avg(CAST(exact AS INT)), 6) AS exact,
           CAST(sum(invented) AS BIGINT) AS invented, CAST(sum(wrong) AS BIGINT) AS wrong, CAST(sum(missed) AS BIGINT) AS missed FROM ({SCORE_SQL})""")
def _(spark, sf_dir):
    out = evaluation.extraction_summary(evaluation.extraction_score(*_score_inputs(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "exact")})
