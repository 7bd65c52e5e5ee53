"""Alerts, failure bursts and log streams over the events table, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators.metrics import BUCKETS
from waymark.plans.aggregates import TELEMETRY_SQL
from waymark.plans.registry import query, spread_table, table
from waymark.plans.retrieval import DEDUP_SQL, THRESHOLD
from waymark.plans.roles import ROLES, role
from waymark.plans.scalar import LOG_LINE
from waymark.session import fresh_path
from waymark.streaming import alerts, breaker, holds, logs
from waymark.streaming.runner import dedup_stream, drain, read_stream


def stream_role(spark, sf_dir, name):
    """The role of a table, derived from the stream of its files."""
    source = read_stream(spark, sf_dir, "events")
    source.createOrReplaceTempView("waymark_events_stream")
    return spark.sql(ROLES[name].replace("{events}", "waymark_events_stream"))


# windows still open when the data ends are not given by a stream in append mode
CLOSED = "epoch_us({end}) <= (SELECT epoch_ms(max(ts)) * 1000 FROM events) - 600000000"


# --- logs ---------------------------------------------------------------------------------------

_RECORDS = f"""SELECT event_id, ts, CASE WHEN event_type IN ('view', 'error') THEN 'app.api.items' ELSE 'worker' END AS logger,
        CASE WHEN value < 5 THEN NULL ELSE user_id END AS user_id, CONCAT({LOG_LINE}, ' password=hunter', CAST(event_id AS STRING)) AS message FROM {{events}}"""
ENRICHED_SQL = f"""
    SELECT event_id, ts, CASE WHEN event_type IN ('view', 'error') THEN 'all' ELSE CAST(user_id AS VARCHAR) END AS target,
           CASE event_type WHEN 'click' THEN '✅ Dataset generated successfully with ' || CAST(user_id % 10 AS VARCHAR) || ' examples' WHEN 'signup' THEN '👋 Welcome! You are now logged in.'
                           WHEN 'error' THEN '❌ LLM provider connection failed' ELSE {LOG_LINE} || ' ***REDACTED***' END AS human_message,
           CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'success' END AS category
    FROM {{events}} WHERE event_type IN ('view', 'error') OR value >= 5"""


def _enriched(records):
    return logs.enrich_logs(records).select("event_id", "ts", "target", "human_message", "category")


@query("enrich_logs", ENRICHED_SQL)
def _(spark, sf_dir):
    return _enriched(spark.sql(_RECORDS, events=spread_table(spark, sf_dir, "events")))


@query("enrich_log_stream", ENRICHED_SQL)
def _(spark, sf_dir):
    read_stream(spark, sf_dir, "events").createOrReplaceTempView("waymark_events_stream")
    return drain(_enriched(spark.sql(_RECORDS.replace("{events}", "waymark_events_stream"))), "enriched")


# --- latency ---------------------------------------------------------------------------------------

@query("latency_per_minute_stream", f"SELECT * FROM ({TELEMETRY_SQL}) WHERE {CLOSED.format(end='minute + INTERVAL 1 MINUTE')}")
def _(spark, sf_dir):
    return drain(alerts.latency_per_minute(stream_role(spark, sf_dir, "telemetry")), "latency")


# --- failures ---------------------------------------------------------------------------------------

# events come minutes apart, so one dependency takes them all and time runs 60 times faster
_OUTCOMES = """SELECT event_id, CAST(0 AS BIGINT) AS name, TIMESTAMP_MICROS(CAST(UNIX_MICROS(ts) / 60 AS BIGINT)) AS ts, event_type NOT IN ('error', 'click', 'view') AS success FROM {events}"""
_OUTCOMES_SQL = """SELECT event_id, 0 AS name, make_timestamp(CAST(epoch_us(ts) / 60 AS BIGINT)) AS ts, event_type NOT IN ('error', 'click', 'view') AS success FROM {events}"""
COUNTS_SQL = f"""
    WITH o AS ({_OUTCOMES_SQL.replace('/ 60', '// 60')}), s AS (SELECT *, CASE WHEN success OR coalesce(lag(success) OVER w, TRUE) OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 60000000 THEN 1 ELSE 0 END AS st FROM o WINDOW w AS (ORDER BY ts, event_id)),
    r AS (SELECT *, sum(st) OVER (ORDER BY ts, event_id) AS run FROM s),
    f AS (SELECT name, event_id, ts, run, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS failures FROM r WHERE NOT success)"""
_OUTCOMES = _OUTCOMES.replace("CAST(UNIX_MICROS(ts) / 60 AS BIGINT)", "UNIX_MICROS(ts) DIV 60")


def _outcomes(spark, sf_dir):
    return spark.sql(_OUTCOMES, events=table(spark, sf_dir, "events"))


def _outcome_stream(spark, sf_dir):
    read_stream(spark, sf_dir, "events").createOrReplaceTempView("waymark_events_stream")
    return spark.sql(_OUTCOMES.replace("{events}", "waymark_events_stream"))


@query("failure_counts", f"{COUNTS_SQL} SELECT CAST(name AS BIGINT) AS name, event_id, ts, failures FROM f")
def _(spark, sf_dir):
    return breaker.failure_counts(_outcomes(spark, sf_dir))


@query("failure_counts_stream", f"{COUNTS_SQL} SELECT CAST(name AS BIGINT) AS name, event_id, ts, failures FROM f")
def _(spark, sf_dir):
    return drain(breaker.failure_counts_stream(_outcome_stream(spark, sf_dir)), "failures")


@query("failure_bursts", f"{COUNTS_SQL} SELECT CAST(name AS BIGINT) AS name, min(ts) AS started_at, max(ts) AS last_at, max(failures) AS failures FROM f GROUP BY name, run HAVING max(failures) >= 5")
def _(spark, sf_dir):
    return breaker.failure_bursts(_outcomes(spark, sf_dir))


# one dependency per user; time runs 3000 times faster, so calls are seconds apart
_CALLS = """SELECT event_id, user_id AS name, TIMESTAMP_MICROS(UNIX_MICROS(ts) DIV 3000) AS ts, event_type NOT IN ('error', 'click', 'view', 'signup') AS success FROM {events}"""
BREAKER_SQL = """
    WITH RECURSIVE o AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY t, event_id) AS n
      FROM (SELECT event_id, user_id AS name, epoch_us(ts) // 3000 AS t, event_type NOT IN ('error', 'click', 'view', 'signup') AS success FROM {events})),
    s AS (
      SELECT DISTINCT name, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS t, '' AS state, TRUE AS admitted, CAST(0 AS BIGINT) AS failures, FALSE AS tripped,
             CAST(0 AS BIGINT) AS f_until, CAST(0 AS BIGINT) AS o_until, CAST(0 AS BIGINT) AS m_until, CAST(0 AS BIGINT) AS p_until FROM o
      UNION ALL
      SELECT name, n, event_id, t, met, ok, after, trip,
             CASE WHEN NOT ok THEN f_until WHEN success THEN 0 ELSE t + 60000000 END,
             CASE WHEN NOT ok THEN o_until WHEN success THEN 0 WHEN trip THEN t + 30000000 ELSE o_until END,
             CASE WHEN NOT ok THEN m_until WHEN success THEN 0 WHEN trip THEN t + 90000000 ELSE m_until END,
             CASE WHEN NOT ok THEN p_until WHEN success OR trip THEN 0 WHEN met = 'half_open' THEN t + 15000000 ELSE p_until END
      FROM (SELECT *, ok AND NOT success AND after >= 5 AS trip FROM (
        SELECT *, CASE WHEN NOT ok THEN failures WHEN success THEN 0 WHEN t < f_until THEN failures + 1 ELSE 1 END AS after FROM (
          SELECT *, met <> 'open' AS ok FROM (
            SELECT o.*, s.failures, s.f_until, s.o_until, s.m_until, s.p_until,
                   CASE WHEN o.t < s.o_until OR (o.t < s.m_until AND o.t < s.p_until) THEN 'open' WHEN o.t < s.m_until THEN 'half_open' ELSE 'closed' END AS met
            FROM s JOIN o ON o.name = s.name AND o.n = s.n + 1)))))
    SELECT name, event_id, make_timestamp(t) AS ts, state, admitted, failures, tripped FROM s WHERE n > 0"""


@query("breaker_timeline", BREAKER_SQL)
def _(spark, sf_dir):
    calls = spark.sql(_CALLS, events=table(spark, sf_dir, "events"))
    return breaker.breaker_timeline(calls, thin=False)


@query("breaker_timeline_stream", BREAKER_SQL)
def _(spark, sf_dir):
    read_stream(spark, sf_dir, "events").createOrReplaceTempView("waymark_events_stream")
    calls = spark.sql(_CALLS.replace("{events}", "waymark_events_stream"))
    return drain(breaker.breaker_timeline_stream(calls), "breaker")


# --- alerts -------------------------------------------------------------------------------------------

def _slide_sql(select: str, window: int, group: str = "", step: int = 30) -> str:
    """Sliding windows of ``window`` seconds every ``step``; ``select`` lists the totals over role http."""
    g = f"{group}, " if group else ""
    return f"""
    SELECT {g}evaluated_at, {select} FROM (SELECT *, unnest(range(s, s + {window}, {step})) AS evaluated_at FROM (SELECT *, (epoch_us(ts) // {step * 1000000} + 1) * {step} AS s FROM {{http}})) GROUP BY {g}evaluated_at"""


def _held_sql(windows: str, condition: str, hold: int, group: str = "", step: int = 30) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    return f"""
    SELECT {g}make_timestamp(CAST(min(evaluated_at) AS BIGINT) * 1000000) AS started_at, make_timestamp(CAST(min(evaluated_at) + {hold} AS BIGINT) * 1000000) AS fired_at, make_timestamp(CAST(max(evaluated_at) AS BIGINT) * 1000000) AS last_at
    FROM (SELECT *, evaluated_at - {step} * row_number() OVER ({part} ORDER BY evaluated_at) AS run FROM ({windows}) WHERE {condition}) GROUP BY {g}run HAVING max(evaluated_at) - min(evaluated_at) >= {hold}"""


_RATIO = _slide_sql("count(*) FILTER (status_code >= 500) / count(*) AS ratio", 300)


def server_error():
    return F.col("status_code") >= 500


@query("error_ratio_alert", _held_sql(_RATIO, "ratio > 0.05", 300))
def _(spark, sf_dir):
    return alerts.ratio_alert(role(spark, sf_dir, "http"), server_error(), **alerts.ERROR_RATIO)


@query("error_ratio_alert_stream", f"""SELECT s AS slice_end, bad, total FROM (
    SELECT make_timestamp((epoch_us(ts) // 30000000 + 1) * 30000000) AS s, count(*) FILTER (status_code >= 500) AS bad, count(*) AS total FROM {{http}} GROUP BY 1) WHERE {CLOSED.format(end='s')}""")
def _(spark, sf_dir):
    """The slices of the stream; the sliding ratio and its duration are read off them as a table."""
    cut = alerts.slices(stream_role(spark, sf_dir, "http"), [], {"bad": F.count_if(server_error()), "total": F.count("*")})
    return drain(cut, "ratio-slices")


@query("error_ratio_fired_from_stream", _held_sql(_slide_sql("count(*) FILTER (status_code >= 500) / count(*) AS ratio", 300).replace(
    "GROUP BY evaluated_at", f"WHERE {CLOSED.format(end='make_timestamp(s * 1000000)')} GROUP BY evaluated_at"), "ratio > 0.05", 300))
def _(spark, sf_dir):
    cut = alerts.slices(stream_role(spark, sf_dir, "http"), [], {"bad": F.count_if(server_error()), "total": F.count("*")})
    placed = alerts.slide(drain(cut, "ratio-slices"), [], ["bad", "total"], 300)
    windows = placed.withColumn("ratio", F.col("bad") / F.col("total"))
    return alerts.sustained(windows, F.col("ratio") > 0.05, "evaluated_at", alerts.STEP, 300)


@query("task_failure_alert", _held_sql(_slide_sql("count(*) FILTER (status_code <> 200) / count(*) AS ratio", 600, "path"), "ratio > 0.1", 300, "path"))
def _(spark, sf_dir):
    return alerts.ratio_alert(role(spark, sf_dir, "http"), F.col("status_code") != 200, group=["path"], **alerts.TASK_FAILURES)


@query("rate_limit_alert", _held_sql(_slide_sql("count(*) FILTER (status_code = 429) / 300 AS rate", 300), "rate > 0.003", 120))
def _(spark, sf_dir):
    # the events given are few, so the bound is low
    return alerts.rate_alert(role(spark, sf_dir, "http"), F.col("status_code") == 429, bound=0.003, window=300, hold=120)


_LE = ", ".join(f"count(*) FILTER (duration_ms <= {b}) AS le_{i}" for i, b in enumerate(BUCKETS["http"])) + ", count(*) AS le_inf"


def _quantile_case(q: float) -> str:
    parts, low, below = [], "0.0", "0"
    for i, b in enumerate(BUCKETS["http"]):
        parts.append(f"WHEN le_{i} >= le_inf * {q}::DOUBLE AND le_{i} > 0 THEN {low} + ({b} - {low}) * (le_inf * {q}::DOUBLE - {below}) / (le_{i} - {below})")
        low, below = str(float(b)), f"le_{i}"
    return "CASE " + " ".join(parts) + f" ELSE {low} END"


@query("latency_quantile_windows", f"SELECT path, make_timestamp(evaluated_at * 1000000) AS evaluated_at, round({_quantile_case(0.99)}, 4) AS quantile FROM ({_slide_sql(_LE, 300, 'path')})")
def _(spark, sf_dir):
    bounds = BUCKETS["http"]
    cut = alerts.quantile_slices(role(spark, sf_dir, "http"), "duration_ms", bounds, ["path"])
    return alerts.quantile_windows(cut, bounds, 0.99, 300, ["path"]).withColumn("quantile", F.round("quantile", 4))


@query("latency_quantile_alert", _held_sql(f"SELECT path, evaluated_at, {_quantile_case(0.99)} AS quantile FROM ({_slide_sql(_LE, 300, 'path')})", "quantile > 5000", 240, "path"))
def _(spark, sf_dir):
    # a path's events are further apart than ten minutes, so it is held for four
    return alerts.quantile_alert(role(spark, sf_dir, "http"), "duration_ms", BUCKETS["http"], **{**alerts.SLOW_PATHS, "hold": 240}, group=["path"])


_LOGINS = "SELECT path, (epoch_us(ts) // 3600000000 + 1) * 3600 AS evaluated_at, count(*) FILTER (status_code <> 200) AS n FROM {http} GROUP BY ALL"


@query("login_failure_alert", _held_sql(_LOGINS, "n > 1", 3600, "path", 3600))
def _(spark, sf_dir):
    return alerts.count_alert(role(spark, sf_dir, "http"), F.col("status_code") != 200, bound=1, window=3600, hold=3600, group=["path"])


@query("login_failure_stream", f"SELECT path, make_timestamp(evaluated_at * 1000000) AS evaluated_at, n FROM ({_LOGINS}) WHERE {CLOSED.format(end='make_timestamp(evaluated_at * 1000000)')}")
def _(spark, sf_dir):
    return drain(alerts.count_windows(stream_role(spark, sf_dir, "http"), F.col("status_code") != 200, 3600, ["path"]), "logins")


_GAUGES = "SELECT path, evaluated_at, arg_max(duration_ms, (ts, duration_ms)) AS value FROM (SELECT *, (epoch_us(ts) // 1800000000 + 1) * 1800 AS evaluated_at FROM {http}) GROUP BY path, evaluated_at"


@query("gauge_threshold_alert", _held_sql(_GAUGES, "value > 4000", 1800, "path", 1800))
def _(spark, sf_dir):
    samples = role(spark, sf_dir, "http").withColumnRenamed("duration_ms", "value")
    return alerts.gauge_alert(samples, F.col("value") > 4000, 1800, ["path"], step=1800)


_ALERTS = """SELECT ts, event_type AS alertname, CASE WHEN user_id < 75 THEN 'a' ELSE 'b' END AS cluster, CONCAT('s', CAST(user_id % 3 AS STRING)) AS service,
        CASE WHEN value > 90 THEN 'critical' WHEN value > 60 THEN 'error' ELSE 'warning' END AS severity FROM {events}"""


@query("group_alerts", f"""
    WITH a AS (SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS slot FROM ({_ALERTS})),
    l AS (SELECT * FROM a WHERE severity <> 'warning' OR NOT EXISTS (SELECT 1 FROM a c WHERE c.severity = 'critical' AND c.slot = a.slot AND c.alertname = a.alertname AND c.cluster = a.cluster))
    SELECT slot, alertname, cluster, service, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at,
           CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity FROM l GROUP BY ALL""")
def _(spark, sf_dir):
    return alerts.group_alerts(spark.sql(_ALERTS, events=table(spark, sf_dir, "events")), interval=12 * 3600)


# --- alerts on the stream, with their holding time -------------------------------------------------------

def _changes_sql(windows: str, condition: str, hold: int, group: str = "", step: int = 30) -> str:
    """Runs over the windows that the watermark has passed: fired once they last, resolved once a step without a hit has passed."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    passed = "(SELECT (epoch_ms(max(ts)) - 600000) / 1000.0 FROM events)"
    return f"""
    WITH held AS (SELECT *, evaluated_at - {step} * row_number() OVER ({part} ORDER BY evaluated_at) AS run FROM ({windows}) WHERE {condition} AND evaluated_at <= {passed}),
    runs AS (SELECT {g}CAST(min(evaluated_at) AS BIGINT) * 1000000 AS a, CAST(max(evaluated_at) AS BIGINT) * 1000000 AS z FROM held GROUP BY {g}run HAVING max(evaluated_at) - min(evaluated_at) >= {hold})
    SELECT {g}state, make_timestamp(a) AS started_at, make_timestamp(a + CAST({hold} AS BIGINT) * 1000000) AS fired_at, CASE WHEN state = 'resolved' THEN make_timestamp(z) END AS last_at
    FROM runs, (SELECT unnest(['firing', 'resolved']) AS state) WHERE state = 'firing' OR z / 1000000 + {step} <= {passed}"""


@query("error_ratio_alert_changes_stream", _changes_sql(_RATIO, "ratio > 0.05", 240))
def _(spark, sf_dir):
    # the events given are minutes apart, so alerts are held for four
    return drain(holds.ratio_alert(stream_role(spark, sf_dir, "http"), server_error(), **{**alerts.ERROR_RATIO, "hold": 240}), "ratio-changes")


@query("task_failure_alert_stream", _changes_sql(_slide_sql("count(*) FILTER (status_code <> 200) / count(*) AS ratio", 600, "path"), "ratio > 0.1", 300, "path"))
def _(spark, sf_dir):
    http = stream_role(spark, sf_dir, "http")
    return drain(holds.ratio_alert(http, F.col("status_code") != 200, group=["path"], **alerts.TASK_FAILURES), "task-changes")


@query("rate_limit_alert_stream", _changes_sql(_slide_sql("count(*) FILTER (status_code = 429) / 300 AS rate", 300), "rate > 0.003", 120))
def _(spark, sf_dir):
    return drain(holds.rate_alert(stream_role(spark, sf_dir, "http"), F.col("status_code") == 429, bound=0.003, window=300, hold=120), "rate-changes")


@query("latency_quantile_alert_stream", _changes_sql(f"SELECT path, evaluated_at, {_quantile_case(0.99)} AS quantile FROM ({_slide_sql(_LE, 300, 'path')})", "quantile > 5000", 240, "path"))
def _(spark, sf_dir):
    http = stream_role(spark, sf_dir, "http")
    return drain(holds.quantile_alert(http, "duration_ms", BUCKETS["http"], **{**alerts.SLOW_PATHS, "hold": 240}, group=["path"]), "quantile-changes")


@query("login_failure_alert_stream", _changes_sql(_LOGINS, "n > 1", 3600, "path", 3600))
def _(spark, sf_dir):
    http = stream_role(spark, sf_dir, "http")
    return drain(holds.count_alert(http, F.col("status_code") != 200, bound=1, window=3600, hold=3600, group=["path"]), "login-changes")


@query("gauge_threshold_alert_stream", _changes_sql(_GAUGES, "value > 4000", 1800, "path", 1800))
def _(spark, sf_dir):
    samples = stream_role(spark, sf_dir, "http").withColumnRenamed("duration_ms", "value")
    return drain(holds.gauge_alert(samples, F.col("value") > 4000, 1800, ["path"], step=1800), "gauge-changes")


# --- spans ----------------------------------------------------------------------------------------------

_STARTS = "SELECT event_id AS span_id, event_type AS name, ts AS started_at FROM {events}"
_ENDS = "SELECT event_id AS span_id, TIMESTAMP_MICROS(UNIX_MICROS(ts) + CAST(ROUND(value * 1000000) AS BIGINT)) AS finished_at, value < 100 AS success FROM {events} WHERE event_type <> 'error'"
_ENDS_SQL = "SELECT event_id AS span_id, make_timestamp(epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT)) AS finished_at, value < 100 AS success FROM {events} WHERE event_type <> 'error'"
SPANS_SQL = f"""SELECT span_id, name, success, round(CAST(epoch_us(finished_at) - epoch_us(started_at) AS DOUBLE) / 1000, 3) AS duration_ms
    FROM ({_STARTS}) LEFT JOIN ({_ENDS_SQL}) USING (span_id)"""


@query("span_durations", SPANS_SQL)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = alerts.span_durations(spark.sql(_STARTS, events=events), spark.sql(_ENDS, events=events))
    return out.select("span_id", "name", "success", "duration_ms")


@query("span_durations_stream", f"SELECT * FROM ({SPANS_SQL}) WHERE duration_ms IS NOT NULL")
def _(spark, sf_dir):
    read_stream(spark, sf_dir, "events").createOrReplaceTempView("waymark_events_stream")
    starts, ends = (spark.sql(s.replace("{events}", "waymark_events_stream")) for s in (_STARTS, _ENDS))
    spans = alerts.span_durations(starts, ends, max_hours=1).filter("duration_ms IS NOT NULL")
    return drain(spans.select("span_id", "name", "success", "duration_ms"), "spans")


@query("span_outcomes_stream", f"""
    WITH e AS ({_ENDS_SQL}), passed AS (SELECT least((SELECT epoch_ms(max(ts)) FROM events), (SELECT epoch_ms(max(finished_at)) FROM e)) - 600000 AS ms)
    SELECT span_id, name, success, duration_ms FROM ({SPANS_SQL}) JOIN (SELECT event_id AS span_id, ts FROM {{events}}) USING (span_id)
    WHERE duration_ms IS NOT NULL OR epoch_ms(ts) + 3600000 < (SELECT ms FROM passed)""")
def _(spark, sf_dir):
    """Spans with their finish, and those still open an hour after their start once the watermark has passed it."""
    events = read_stream(spark, sf_dir, "events")
    starts, ends = (spark.sql(s, events=events) for s in (_STARTS, _ENDS))
    return drain(alerts.span_durations(starts, ends, max_hours=1).select("span_id", "name", "success", "duration_ms"), "span-outcomes")


# --- near-duplicates ---------------------------------------------------------------------------------------

@query("dedup_stream", f"{DEDUP_SQL} SELECT label, vec_id FROM g WHERE kept")
def _(spark, sf_dir):
    """Vectors arrive in two lots, in as many files as there are: the first three quarters by number, then the rest."""
    source, out, checkpoint = (fresh_path(spark, label) for label in ("arriving", "accepted", "dedup-checkpoint"))
    rows = table(spark, sf_dir, "embeddings")
    border = rows.agg(F.max("vec_id") * 0.75).first()[0]
    for early in (True, False):
        rows.filter((F.col("vec_id") <= border) == early).write.mode("append").parquet(source)
        writer = dedup_stream(spark.readStream.schema(rows.schema).parquet(source), out, "vec_id", bucket=("label",), threshold=THRESHOLD)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("label", "vec_id")
