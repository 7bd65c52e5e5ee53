"""JSON parsing with a fallback, typed casts, placeholder and comparison rules, error categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "not given".
PLACEHOLDERS = ["", "null", "none", "n/a", "na", "unknown", "not provided", "not specified", "<string>", "string"]
# Fields compared as free text.
FREE_TEXT_FIELDS = ["reason", "body", "full_name", "timezone", "role"]
# SQL type of each JSON Schema type.
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
# Error categories by the words that show them, first match wins.
ERROR_WORDS = [
    ("api_error", ["api"]),
    ("json_parsing_error", ["json", "parse"]),
    ("timeout_error", ["timeout"]),
    ("rate_limit_error", ["rate", "limit"]),
    ("auth_error", ["auth", "key"]),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def parse_json_or_raw(text: Column) -> Column:
    """The text when it is JSON, ``{"raw": text}`` when it is not, null for null."""
    parsed = F.try_parse_json(text)
    return F.when(text.isNull(), None).when(parsed.isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("raw"))))


def is_absent(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(PLACEHOLDERS)


def typed_coerce(value: Column, field_type: Column) -> Column:
    """Struct (value, problem): the value rendered as its schema type, or why it is not one."""
    whole = value.try_cast("double")
    integer = F.coalesce(value.try_cast("bigint"), F.when(whole == F.floor(whole), whole.try_cast("bigint")))
    truth = F.when(F.lower(value).isin("true", "1", "yes", "on", "y", "t"), "true").when(
        F.lower(value).isin("false", "0", "no", "off", "n", "f"), "false"
    )
    rendered = (
        F.when(field_type == "integer", integer.cast("string"))
        .when(field_type == "number", whole.cast("string"))
        .when(field_type == "boolean", truth)
        .when(field_type == "array", F.when(F.from_json(value, "array<string>").isNotNull() & value.rlike(r"^\s*\["), value))
        .when(field_type == "object", F.when(F.try_parse_json(value).isNotNull() & value.rlike(r"^\s*\{"), value))
        .otherwise(value)
    )
    problem = F.when(value.isNotNull() & rendered.isNull(), F.concat(F.lit("not a valid "), F.coalesce(field_type, F.lit("value"))))
    return F.struct(F.coalesce(rendered, value).alias("value"), problem.alias("problem"))


def _loose(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9/_ ]+", ""))


def loose_match(field: Column, field_type: Column, expected: Column, got: Column) -> Column:
    """Whether an extracted value equals the labelled one, by the rule of its type."""
    a, b = _loose(expected), _loose(got)
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    free = (F.length(short) > 0) & long.contains(short) & (F.length(short) / F.length(long) >= 0.6)
    number = F.coalesce(F.abs(got.try_cast("double") - expected.try_cast("double")) < 1e-6, F.lit(False))
    verdict = (
        F.when(field_type == "boolean", got == expected)
        .when(field_type.isin("integer", "number"), number)
        .when(field.contains("email"), F.lower(F.trim(got)) == F.lower(expected))
        .when(field.isin(FREE_TEXT_FIELDS), free)
        .otherwise(F.trim(got) == expected)
    )
    return F.coalesce(verdict, F.lit(False))


def classify_error(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, words in ERROR_WORDS:
        hit = low.contains(words[0])
        for word in words[1:]:
            hit = hit | low.contains(word)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("unknown"))
