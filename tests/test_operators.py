"""Catalogue lifecycle, breaker, percentiles, extraction, sources."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import cases, catalogue, datasets, evaluation, extraction, metrics, templates
from waymark.session import fresh_path
from waymark.sources import files, vectors
from waymark.streaming import alerts, breaker

UTC = dt.timezone.utc
NOW = dt.datetime(2024, 3, 10, tzinfo=UTC)
CATALOG = "scope string, provider string, model_id string, kind string, status string, missing_since timestamp, retired_at timestamp, first_seen_at timestamp"
LISTING = "scope string, provider string, model_id string, kind string, shutdown_date date"


def sync(spark, existing, listing, ok=True, failures=0):
    e = spark.createDataFrame([("global", "p", m, "llm", s, miss, None, NOW - dt.timedelta(days=30)) for m, s, miss in existing], CATALOG)
    li = spark.createDataFrame([("global", "p", m, "llm", end) for m, end in listing], LISTING)
    g = spark.createDataFrame([("global", "p", ok, failures)], "scope string, provider string, listed_ok boolean, failures int")
    return {r["model_id"]: (r["status"], r["transition"]) for r in catalogue.sync_catalog(e, li, g, NOW).collect()}


def test_catalogue_lifecycle(spark):
    long_ago, lately = NOW - dt.timedelta(hours=80), NOW - dt.timedelta(hours=10)
    before = [("kept", "active", None), ("gone", "active", None), ("late", "deprecated", long_ago), ("grace", "deprecated", lately), ("back", "deprecated", long_ago)]
    listed = [("kept", None), ("back", None), ("new", None), ("ended", dt.date(2024, 3, 1))]
    assert sync(spark, before, listed) == {
        "kept": ("active", "active"), "gone": ("deprecated", "deprecated"), "late": ("retired", "retired"), "grace": ("deprecated", "unchanged"),
        "back": ("active", "active"), "new": ("active", "added"), "ended": ("retired", "added_retired"),
    }
    # one failed listing: what was not seen stays; none at all: nothing changes
    partly = sync(spark, before, listed, failures=1)
    assert partly["gone"] == ("active", "unchanged") and partly["late"] == ("deprecated", "unchanged") and partly["new"][1] == "added"
    assert {v[1] for v in sync(spark, before, [], ok=False).values()} == {"unchanged"}


def outcomes(spark, rows):
    return spark.createDataFrame([(1, i, dt.datetime.fromtimestamp(s, UTC), ok) for i, (s, ok) in enumerate(rows)], "name bigint, event_id bigint, ts timestamp, success boolean")


def test_breaker_history(spark):
    calls = [(i, False) for i in range(5)] + [(10, False), (40, False), (50, True), (72, True), (80, False)]
    got = {r["event_id"]: (r["state"], r["admitted"], r["tripped"]) for r in breaker.breaker_timeline(outcomes(spark, calls)).collect()}
    assert got[4] == ("closed", True, True)
    assert got[5] == ("open", False, False)
    assert got[6] == ("half_open", True, True)  # the probe fails and blocks again
    assert got[7] == ("open", False, False)
    assert got[8] == ("half_open", True, False)  # the probe succeeds
    assert got[9] == ("closed", True, False)


def test_success_and_silence_reset_failures(spark):
    calls = [(0, False), (30, False), (80, False), (150, False), (160, True), (170, False)]
    got = [r["failures"] for r in breaker.failure_counts(outcomes(spark, calls)).orderBy("event_id").collect()]
    assert got == [1, 2, 3, 1, 1]


def test_thinned_outcomes_change_nothing(spark, sf_dir):
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit(1).cast("bigint").alias("name"), "event_id", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)).alias("ts"), (F.col("event_type") != "error").alias("success"))
    thin = breaker.thin_outcomes(calls)
    assert thin.count() < calls.count()
    full = breaker.breaker_timeline(calls, thin=False).join(thin.select("event_id"), "event_id", "left_semi")
    assert full.exceptAll(breaker.breaker_timeline(calls).select(full.columns)).count() == 0
    assert breaker.failure_counts(calls).count() == calls.filter(~F.col("success")).count()


def test_index_percentiles_with_copies_and_a_tail(spark):
    data = [1.0] * 700 + [float(i) for i in range(300)] + [1e9]
    df = spark.createDataFrame([("s", v) for v in data], "strategy string, latency_ms double")
    s, n = sorted(data), len(data)
    r = evaluation.routing_percentiles(df).first()
    assert (r["p50_ms"], r["p95_ms"]) == (s[n // 2], s[min(n - 1, int(n * 0.95))])
    single = spark.createDataFrame([("s", 4.0)], "strategy string, latency_ms double")
    assert tuple(evaluation.routing_percentiles(single).first())[1:] == (4.0, 4.0)


def test_gate_fails_an_unknown_strategy(spark):
    summary = spark.createDataFrame([("a", "overall", 0.8)], "strategy string, tier string, hit_1 double")
    assert evaluation.accuracy_gate(summary, "a", 0.78).first()["passed"] is True
    assert evaluation.accuracy_gate(summary, "b", 0.0).first()["passed"] is False


def test_extraction_scoring(spark):
    e = spark.createDataFrame([(1, "email", "string", "A@b.c"), (1, "n", "number", "5"), (2, None, None, None), (3, "items", "array", "[]")], "case_id int, field string, field_type string, expected string")
    g = spark.createDataFrame([(1, "email", "a@B.c"), (1, "x", "1"), (3, "items", '["k"]')], "case_id int, field string, got string")
    got = {r["case_id"]: (r["correct"], r["wrong"], r["invented"], r["missed"], r["exact"]) for r in evaluation.extraction_score(e, g).collect()}
    assert got == {1: (1, 0, 1, 1, False), 2: (0, 0, 0, 0, True), 3: (1, 0, 0, 0, True)}


SCHEMA = """{"type": "object", "required": ["order_id"], "properties": {
  "order_id": {"type": "string"}, "user_id": {"type": "string"}, "email": {"type": "string"}, "status": {"type": "string", "enum": ["open", "closed"]},
  "amount": {"type": "number"}, "page": {"type": "integer"}, "refresh_token": {"type": "string"}, "currency": {"type": "string"}, "note": {"type": "string"}}}"""


def rules(spark, said):
    t = spark.createDataFrame([(1, "update_order", "/v1/orders", SCHEMA)], "t_id int, api_name string, endpoint string, json_schema string")
    r = spark.createDataFrame([(1, 1, said)], "request_id int, t_id int, text string")
    return {x["field"]: x["value"] for x in extraction.rule_rows(extraction.extract_by_rules(r, t)).collect()}


@pytest.mark.parametrize("said, want", [
    ("set order #8820 to closed", {"order_id": "8820", "status": "closed"}),
    ("order 12 or order 13", {}),
    ("mail kim@x.org, page 3.", {"email": "kim@x.org", "page": "3"}),
    ("kim@x.org and lee@x.org", {}),
    ("refund 25,50 EUR on order A-7", {"order_id": "A-7", "currency": "EUR"}),  # two numeric fields are open, so 25,50 is nobody's
    ("refund 25,50 for page 2", {"amount": "25.5", "page": "2"}),
    ("open or closed?", {}),
    ("my refresh token is Zx_9!.", {"refresh_token": "Zx_9!"}),
    ("order status for user u_77af", {"user_id": "u_77af"}),
    ("hello there", {}),
])
def test_rules(spark, said, want):
    assert rules(spark, said) == want


def test_grounding_reasons(spark):
    said = "tell user 88 that the meeting moved to Monday"
    cases_ = [
        ("note", "tell user 88 that the meeting moved to Monday", None),  # the command in front is dropped
        ("note", "an invented text", "not in the request"),
        ("amount", "89", "that number is not in the request"), ("amount", "88", None),
        ("status", "lost", "not one of ['open', 'closed']"), ("status", "open", "inferred, not stated"),
        ("refresh_token", "meeting moved", "a single value was expected, not a phrase"), ("currency", "user", "only repeats the command"),
    ]
    t = spark.createDataFrame([(1, "notify_user", "/v1/notes", SCHEMA)], "t_id int, api_name string, endpoint string, json_schema string")
    reqs = spark.createDataFrame([(i, 1, said) for i in range(len(cases_))], "request_id int, t_id int, text string")
    base = extraction.with_fields(reqs, t).withColumn("claims", F.array().cast(f"array<{extraction.CLAIM}>"))
    props = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(cases_)], "request_id int, field string, value string")
    got = {r["request_id"]: r["problem"] for r in extraction.ground_proposals(base, props).collect()}
    assert [got[i] for i in range(len(cases_))] == [c[2] for c in cases_]


def test_nested_leaves_ground_a_structure(spark):
    df = spark.createDataFrame([('{"sku": "A-9", "qty": 2}',), ('{"a": [true, "x y"], "b": null}',)], "v string")
    got = [sorted(r["l"]) for r in df.select(extraction.json_leaves(F.col("v")).alias("l")).collect()]
    assert got == [["2", "A-9"], ["true", "x y"]]


def test_vector_width_is_checked(spark):
    df = spark.createDataFrame([(1, "d", [1.0, 2.0]), (2, "d", [1.0])], "row_uid int, dataset_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        vectors.append_vectors(df, fresh_path(spark, "bad"), "p", "m", 2)


def test_cells_with_quotes_and_breaks_survive(spark):
    rows = [('say "hi", then\nleave', "x"), ("  padded ", 'back\\slash "q"'), (None, "dropped"), ("NA", "dropped")]
    path = fresh_path(spark, "cells")
    files.write_cases(spark.createDataFrame(rows, "query string, notes string"), path)
    got = sorted((r["query"], r["notes"]) for r in files.read_utterances(spark, path).collect())
    assert got == sorted(rows[:2])


@pytest.mark.parametrize("said, queries", [
    ('```json\n[{"query": "a"}, {"query": "b"},]\n```', ["a", "b"]),
    ('{"test_cases": [{"query": "a"}]}', ["a"]),
    ('noise {"query": "a", "request": {"x": 1}} more {"query": "b"} {"other": 1}', ["a", "b"]),
    ("[{'query': 'a'}]", ["a"]),
    ('import os\n[{"query": "a"}]', []),
    ('{"query": "a"}', ["a"]),
    ("no json", []),
    ('a {"query": "a"} } {"query": "lost"} {', ["a"]),
    ('{{"query": "in"}} then {"query": "\u00e9\U0001f600"} {"query": cut} {"query": "z", "n": {"k": {"m": null}}}', ["\u00e9\U0001f600", "z"]),
    ("", []),
    (None, []),
])
def test_salvage(spark, said, queries):
    df = spark.createDataFrame([(1, said)], "id int, raw string")
    got = cases.salvage_json_cases(df, "raw", ["id"]).orderBy("case_no").select(F.try_element_at("fields", F.lit("query")).alias("q")).collect()
    assert [r["q"] for r in got] == queries


def test_unknown_state_is_rejected(spark):
    sets = spark.createDataFrame([(1, "pending", 0, None, 0)], "dataset_id int, embedding_status string, embedding_progress int, embedding_error string, embedded_rows bigint")
    bad = spark.createDataFrame([(1, "paused", 5, None, None)], "dataset_id int, status string, progress int, error string, embedded_rows bigint")
    with pytest.raises(Exception, match="invalid embedding_status"):
        datasets.advance_embedding_status(sets, bad).collect()


def test_required_flag_and_types(spark):
    t = spark.createDataFrame([(1, SCHEMA), (2, "not json"), (3, None)], "t_id int, json_schema string")
    rows = templates.schema_fields(t).collect()
    assert {r["t_id"] for r in rows} == {1} and [r["field"] for r in rows if r["required"]] == ["order_id"]


def test_schema_fields_twelve_levels_down(spark):
    def nested(n):
        if n == 0:
            return {"type": "string", "enum": ["a", "b"]}
        inner = {"type": "object", "required": ["x"], "properties": {"x": nested(n - 1), f"y{n}": {"type": ["null", "integer"]}}}
        return inner if n % 3 else {"type": "array", "items": inner}

    top = {"properties": {"x": nested(11), "z": {"format": "email"}}}
    t = spark.createDataFrame([(1, json.dumps(top)), (1, json.dumps(top)), (2, "[1]"), (None, '{"properties": {"q": {}}}')], "t_id int, json_schema string")
    rows = templates.schema_fields(t).collect()

    def walk(schema, prefix):
        for name, spec in schema.get("properties", {}).items():
            yield prefix + name
            if spec.get("type") == "object":
                yield from walk(spec, f"{prefix}{name}.")
            elif spec.get("type") == "array":
                yield from walk(spec["items"], f"{prefix}{name}[].")

    want = list(walk(top, ""))
    assert max(f.count(".") for f in want) == 11
    # The template that is there twice is walked twice.
    assert sorted((r["ordinal"], r["field"]) for r in rows if r["t_id"] == 1) == sorted([*enumerate(want)] * 2)
    assert [(r["ordinal"], r["field"], r["type"]) for r in rows if r["t_id"] is None] == [(0, "q", "string")]
    assert not [r for r in rows if r["t_id"] == 2]
    assert {r["field"] for r in templates.schema_fields(t, 2).collect()} == {f for f in want if f.count(".") < 2} | {"q"}
    assert templates.schema_fields(t.limit(0)).count() == 0


def test_sustained_needs_an_unbroken_run(spark):
    at = [0, 30, 60, 120, 150]
    df = spark.createDataFrame([(dt.datetime.fromtimestamp(s, UTC), 1.0) for s in at], "at timestamp, v double")
    got = metrics.sustained(df, F.col("v") > 0, "at", 30, 60).collect()
    assert len(got) == 1 and got[0]["fired_at"] == dt.datetime.fromtimestamp(60, UTC).replace(tzinfo=None)


def test_critical_mutes_warning(spark):
    ts = dt.datetime(2024, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([(ts, "a", "c", "s", "critical"), (ts, "a", "c", "s2", "warning"), (ts, "b", "c", "s", "warning")],
                               "ts timestamp, alertname string, cluster string, service string, severity string")
    assert sorted((r["alertname"], r["service"]) for r in alerts.group_alerts(df).collect()) == [("a", "s"), ("b", "s")]


@pytest.mark.parametrize("said, queries", [
    ('x {"query": "a", "query": "b"} y', ["b"]),
    ('{"query": "a", "n": NaN}', ["a"]),
    ('{"query": "a", "query": "b", "n": {"k": 1, "k": 2}}', ["b"]),
    ('[{"query": "a", "query": "b"}, {"query": "c"}]', ["b", "c"]),
    ('{"test_cases": [{"query": "a", "query": "b"}, {"query": "c"}]}', ["b", "c"]),
    ('{"query": "a", "query": "b"} } {"query": "c"}', ["b"]),
    ('{"query": "a", "query": "b"} , {"query": "c", "n": NaN}', ["b", "c"]),
])
def test_salvage_keeps_repeated_names_and_nan(spark, said, queries):
    df = spark.createDataFrame([(1, said)], "id int, raw string")
    got = cases.salvage_json_cases(df, "raw", ["id"]).orderBy("case_no").select(F.try_element_at("fields", F.lit("query")).alias("q")).collect()
    assert [r["q"] for r in got] == queries


def test_strategies_name_sources(spark):
    said = "tell user 88 that the meeting moved to Monday, mail kim@x.org"
    t = spark.createDataFrame([(1, "notify_user", "/v1/notes", SCHEMA)], "t_id int, api_name string, endpoint string, json_schema string")
    reqs = spark.createDataFrame([(1, 1, said), (2, 1, said), (3, 9, said), (4, 1, None)], "request_id int, t_id int, text string")
    # two values for one field, a field the rules have, an absent value, an unknown field, a request nobody made
    props = spark.createDataFrame(
        [(1, "note", "the meeting moved"), (1, "note", "zzz"), (1, "email", "lee@x.org"), (1, "amount", "n/a"), (1, "made_up", "x"), (1, "page", "many"), (3, "note", "x"), (7, "note", "x"), (None, "note", "x")],
        "request_id int, field string, value string",
    )
    base = extraction.extract_by_rules(reqs, t)

    def told(strategy):
        rows = extraction.assemble_extraction(base, props, strategy).collect()
        assert sorted(r["request_id"] for r in rows) == [1, 2, 3, 4]
        return {r["request_id"]: r for r in rows}

    both, ruled, alone = (told(s) for s in ("hybrid", "rules", "proposals"))
    assert {k: tuple(v) for k, v in both[1]["fields"].items()} == {
        "user_id": ("88", "rule", 0.99), "email": ("kim@x.org", "rule", 0.99), "note": ("the meeting moved", "proposal", 0.85)}
    assert both[1]["confidence"] == 0.85 and [u["field"] for u in both[1]["unverified"]] == ["page"]
    assert set(ruled[1]["fields"]) == {"user_id", "email"} and ruled[1]["unverified"] == [] and both[2]["fields"] == ruled[2]["fields"]
    assert {k: tuple(v) for k, v in alone[1]["fields"].items()} == {"note": ("the meeting moved", "proposal", None), "email": ("lee@x.org", "proposal", None)}
    assert not alone[1]["ok"] and alone[1]["confidence"] is None and alone[2]["fields"] == {}
    assert all(x[i]["fields"] == {} for x in (both, ruled, alone) for i in (3, 4)) and both[3]["ok"]
    with pytest.raises(ValueError):
        extraction.assemble_extraction(base, props, "llm")
