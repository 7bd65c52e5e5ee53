"""Column functions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import intent, logs, models, net, scrub, text, values


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("said, tokens", [
    ("Pay_331 now", ["pay", "331", "now"]),
    ("ab12c x9", ["ab12c", "ab", "12", "x9"]),
    ("", []),
    ("Größe-7", ["gr", "e", "7"]),
])
def test_tokenize(spark, said, tokens):
    assert one(spark, said, text.tokenize) == tokens


def test_char_grams_are_overlapping_and_padded(spark):
    assert one(spark, "Hi-yo", text.char_grams) == [" hi", "hi ", "i y", " yo", "yo "]
    # a letter outside the basic plane must not leave broken halves
    assert one(spark, "a\U0001d49cb", text.char_grams) == [" a\U0001d49c", "a\U0001d49cb", "\U0001d49cb "]
    assert one(spark, "", text.char_grams) == []


@pytest.mark.parametrize("said, url", [
    ("open www.Example.com and go", "https://www.example.com"),
    ("write to kim@shop.io", None),
    ("HTTP://Host.Org/A/b?q=1.", "http://host.org/A/b?q=1"),
    ("(see docs.site.dev:8080/x)", "https://docs.site.dev:8080/x"),
    ("version 1.2.3 is out", None),
    ("nothing", None),
])
def test_normalised_url(spark, said, url):
    assert one(spark, said, text.normalised_url) == url


def test_path_and_ansi(spark):
    assert one(spark, "/v1/0a1b2c3d-4e5f/items/abc", text.normalise_path) == "/v1/{id}/items/abc"
    assert one(spark, "\x1b[1;31mred\x1b[0m", text.strip_ansi) == "red"


def test_intents(spark):
    assert one(spark, "patch", intent.intent_from_method) == "update"
    assert one(spark, "TRACE", intent.intent_from_method) == "query"
    assert one(spark, None, intent.intent_from_method) == "unknown"
    assert tuple(one(spark, "please delete and remove it", intent.intent_from_text)) == ("delete", 0.85)
    # one phrase each for create and update: the first declared wins
    assert tuple(one(spark, "add or edit", intent.intent_from_text)) == ("create", 0.70)
    assert tuple(one(spark, "zzz", intent.intent_from_text)) == ("unknown", 0.5)
    assert tuple(one(spark, "", intent.intent_from_text)) == ("unknown", 0.0)


@pytest.mark.parametrize("raw, clean", [
    ("Authorization: Bearer abc.DEF-1==", "Authorization: ***REDACTED***"),
    ("token eyJhbG.eyJzdWI.sig_1 end", "token ***REDACTED*** end"),
    ("postgresql+asyncpg://app:hunter2@db/x", "postgresql+asyncpg://app:***REDACTED***@db/x"),
    ("redis://:pw@cache:6379", "redis://:***REDACTED***@cache:6379"),
    ("PASSWORD = abc&x=1", "***REDACTED***&x=1"),
    ("api-key=K1 ok", "***REDACTED*** ok"),
])
def test_scrub_text(spark, raw, clean):
    assert one(spark, raw, scrub.scrub_text) == clean


def test_scrub_json_recurses_and_keeps_numbers(spark):
    doc = '{"n": 5, "ok": true, "s": "7", "inner": {"token": "t", "list": ["password=x", {"email": "a@b.c"}]}, "none": null}'
    import json

    out = json.loads(one(spark, doc, scrub.scrub_json))
    assert out == {"n": 5, "ok": True, "s": "7", "inner": {"token": "***REDACTED***", "list": ["***REDACTED***", {"email": "***PII***"}]}, "none": None}


def test_every_log_rule_is_reachable(spark):
    said = {
        "Using Gemini model gem-1": ("🤖 Gemini: Using model 1", "llm"),
        "Starting dataset generation with model=gem:2": ("🚀 Dataset generation started using gem", "dataset"),
        "Dataset generation completed: 7 rows": ("✅ Dataset generated successfully with 7 examples", "dataset"),
        "Rate limit exceeded": ("⚠️ Rate limit exceeded. Please wait before trying again.", "system"),
        "User kim logged in": ("👋 Welcome! You are now logged in.", "auth"),
        "Task 9 retry 3": ("🔁 Task retrying (attempt 3)", "system"),
    }
    rows = spark.createDataFrame([(k,) for k in said], "m string").select("m", logs.classify_log(F.col("m")).alias("c")).collect()
    assert {r["m"]: (r["c"]["human_message"], r["c"]["activity_type"]) for r in rows} == said


def test_model_kinds(spark):
    rows = [("text-embed-3", None, None, "embedding"), ("gpt-image-1", None, None, None), ("m", "chat", None, "llm"), ("m", "image", None, None),
            ("m", None, ["text"], "llm"), ("whisper-1", None, ["text"], None), ("m", None, ["embeddings"], "embedding")]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, id string, t string, o array<string>")
    got = [r["k"] for r in df.orderBy("i").select(models.classify_model(F.col("id"), F.col("t"), F.col("o")).alias("k")).collect()]
    assert got == [r[3] for r in rows]


@pytest.mark.parametrize("forwarded, peer, client", [
    ("9.9.9.9, 10.0.0.1", "172.16.4.4", "9.9.9.9"), ("9.9.9.9", "172.32.0.1", "172.32.0.1"), (None, None, "unknown"),
    ("9.9.9.9", "::1", "9.9.9.9"), (" ,x", "10.0.0.1", "10.0.0.1"), ("9.9.9.9", "not-an-ip", "not-an-ip"),
])
def test_client_ip(spark, forwarded, peer, client):
    df = spark.createDataFrame([(forwarded, peer)], "f string, p string")
    assert df.select(net.client_ip(F.col("f"), F.col("p"))).first()[0] == client


def test_coercion(spark):
    df = spark.createDataFrame([("7.0", "integer"), ("7.5", "integer"), ("x", "number"), ("yes", "boolean"), ("[1]", "array"), ("{", "object"), ("s", "string")], "v string, t string")
    got = [tuple(r["c"]) for r in df.select(values.typed_coerce(F.col("v"), F.col("t")).alias("c")).collect()]
    assert got == [("7", None), ("7.5", "not a valid integer"), ("x", "not a valid number"), ("true", None), ("[1]", None), ("{", "not a valid object"), ("s", None)]


def test_json_or_raw(spark):
    assert one(spark, "{broken", values.parse_json_or_raw) == '{"raw":"{broken"}'
    assert one(spark, '{"a": 1}', values.parse_json_or_raw) == '{"a": 1}'
    assert one(spark, None, values.parse_json_or_raw) is None


def test_secrets_are_hidden_at_any_depth(spark):
    import json

    doc = '{"a":{"b":{"c":{"d":{"e":{"password":"s3cret x","n":5,"list":[{"Token":"t0ps"}],"email":"q@w.e"}}}}}}'
    out = one(spark, doc, scrub.scrub_json)
    assert "s3cret" not in out and "t0ps" not in out and "q@w.e" not in out
    assert json.loads(out)["a"]["b"]["c"]["d"]["e"]["n"] == 5


def test_scrub_json_hides_nested_values_below_six_levels(spark):
    import json

    held = [
        '{"password":{"x":{"y":"s3cret"}}}', '{"token":[["s3cret"],[{"z":"s3cret"}]]}', '{"email":{"a":{"b":["s3cret"]}}}',
        '{"list":[[{"secret":{"deep":{"er":"s3cret"}}}]]}', '{"note":["password=s3cret"]}',
    ]
    for value in held:
        doc = '{"l1":{"l2":{"l3":{"l4":{"l5":{"l6":' + value + '}}}}},"n":1.50,"twice":1,"twice":{"key":"s3cret"}}'
        out = one(spark, doc, scrub.scrub_json)
        assert "s3cret" not in out and '"n":1.50' in out and json.loads(out)["l1"]["l2"]["l3"]["l4"]["l5"]["l6"]
    long = one(spark, '{"a":{"b":{"c":{"d":{"e":{"prompt":"' + "k" * 250 + '"}}}}}}', scrub.scrub_json)
    assert "k" * 200 + "...[truncated 50 chars]" in long
    deep = one(spark, '{"a":' * 900 + '{"pass":{"x":"s3cret"}}' + "}" * 900, scrub.scrub_json)
    assert deep == '{"a":' * 900 + '{"pass":"***REDACTED***"}' + "}" * 900
    assert one(spark, "{'token': 't', 'n': 1}", scrub.scrub_json) == '{"token":"***REDACTED***","n":1}'
    assert one(spark, "[1", scrub.scrub_json) is None
