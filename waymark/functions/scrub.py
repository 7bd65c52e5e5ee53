"""Removal of secrets and personal data from log text and log fields."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "***REDACTED***"
PII_MASKED = "***PII***"
PROMPT_LIMIT = 200
# Field names whose value is always hidden.
SENSITIVE_KEYS = [
    "password", "passwd", "pass", "secret", "secret_key", "signing_key", "api_key", "apikey", "api_secret", "token",
    "access_token", "refresh_token", "id_token", "jwt", "authorization", "auth", "private_key", "client_secret",
    "database_url", "db_url", "db_password", "smtp_password", "smtp_pass", "encryption_key", "key",
]
# Personal fields, hidden in production.
PII_KEYS = ["email", "user_email", "phone", "phone_number", "ssn", "dob", "date_of_birth", "ip_address", "client_ip"]
# Fields holding user input, shortened when long.
PROMPT_KEYS = ["prompt", "user_prompt", "input", "query", "text", "content"]
# Secrets inside text, with what replaces them. A Redis URL loses its
# password as well, where the original behaviour would keep it.
TEXT_RULES = [
    (r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", REDACTED),
    (r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", REDACTED),
    (r"(?i)(postgresql(?:\+\w+)?://[^:]+:)([^@]+)(@)", "$1" + REDACTED + "$3"),
    (r"(?i)(redis://:)[^@]+(@)", "$1" + REDACTED + "$2"),
    (r"""(?i)password\s*=\s*[^\s&"']+""", REDACTED),
    (r"""(?i)api[_-]?key\s*=\s*[^\s&"']+""", REDACTED),
]


def scrub_text(text: Column) -> Column:
    for pattern, replacement in TEXT_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def scrub_value(key: Column, value: Column, production: bool = True) -> Column:
    """One field: hidden by name, shortened when it is user input, else scrubbed as text."""
    name = F.lower(key)
    cut = F.concat(
        F.substring(value, 1, PROMPT_LIMIT),
        F.lit("...[truncated "), (F.length(value) - PROMPT_LIMIT).cast("string"), F.lit(" chars]"),
    )
    out = F.when(name.isin(SENSITIVE_KEYS), F.lit(REDACTED))
    if production:
        out = out.when(name.isin(PII_KEYS), F.lit(PII_MASKED))
    return out.when(name.isin(PROMPT_KEYS) & (F.length(value) > PROMPT_LIMIT), cut).otherwise(scrub_text(value))


def scrub_fields(fields: Column, production: bool = True) -> Column:
    """MAP<STRING, STRING> of flat log fields."""
    return F.transform_values(fields, lambda k, v: scrub_value(k, v, production))


class _Bare(str):
    """A number, or a word such as NaN, as the document spells it."""


class _Members(list):
    """Names and values of an object, in order; repeated names stay."""


_DECODER = json.JSONDecoder(object_pairs_hook=_Members, parse_int=_Bare, parse_float=_Bare, parse_constant=_Bare, strict=False)
_RULES = [(re.compile(p, re.ASCII), re.sub(r"\$(\d)", r"\\g<\1>", r)) for p, r in TEXT_RULES]


def _decoded(doc: str | None):
    if doc is None:
        return None
    try:
        found = _DECODER.raw_decode(doc.lstrip())[0]
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, _Members) else None


def _scrubbed(root: _Members, production: bool) -> str:
    """The object as text; a stack of what is still to be written stands in for recursion."""
    hidden = dict.fromkeys(PII_KEYS, PII_MASKED) if production else {}
    hidden |= dict.fromkeys(SENSITIVE_KEYS, REDACTED)
    said, left = [], [("", root)]
    while left:
        at = left.pop()
        if isinstance(at, str):
            said.append(at)
            continue
        name, value = at
        low = name.lower()
        if low in hidden:
            said.append(f'"{hidden[low]}"')
        elif isinstance(value, list):
            is_object = isinstance(value, _Members)
            said.append("{" if is_object else "[")
            parts = []
            for n, item in enumerate(value):
                head = "," * (n > 0)
                parts += [head + json.dumps(item[0], ensure_ascii=False) + ":", item] if is_object else [head, (name, item)]
            left += ["}" if is_object else "]", *reversed(parts)]
        elif isinstance(value, str) and not isinstance(value, _Bare):
            if low in PROMPT_KEYS and len(value) > PROMPT_LIMIT:
                value = f"{value[:PROMPT_LIMIT]}...[truncated {len(value) - PROMPT_LIMIT} chars]"
            else:
                for pattern, replacement in _RULES:
                    value = pattern.sub(replacement, value)
            said.append(json.dumps(value, ensure_ascii=False))
        else:
            said.append(value if isinstance(value, _Bare) else json.dumps(value))
    return "".join(said).encode("utf-8", "replace").decode()


def scrub_json(doc: Column, production: bool = True) -> Column:
    """
    JSON object text of any shape and depth, scrubbed member by member; null when it is not an object.

    Members of arrays keep the name of the array. Spark's reader has a second try at what Python's refuses, such as single quotes.
    """

    @F.udf("string", useArrow=True)
    def scrubbed(text, lenient):
        found = _decoded(text)
        found = _decoded(lenient) if found is None else found
        return None if found is None else _scrubbed(found, production)

    wrapped = F.from_json(F.concat(F.lit('{"v":'), doc, F.lit("}")), "map<string,string>")
    return scrubbed(doc, F.when(F.try_parse_json(doc).isNull(), F.try_element_at(wrapped, F.lit("v"))))
