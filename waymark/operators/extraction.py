"""
Field extraction from request texts: rules first, then proposed values checked against the text.

One row holds one request with the field list of its template, so the rules, which depend on
each other through the characters they claim, run as folds over that short list inside a
single projection. No shuffle is needed beyond joining the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import alnum_words, word_parts
from waymark.functions.values import is_absent, let, typed_coerce
from waymark.operators.templates import fields_array

# Confidence of a rule, of a grounded value, of a switch that was inferred.
RULE_CONFIDENCE, GROUNDED_CONFIDENCE, INFERRED_CONFIDENCE = 0.99, 0.85, 0.7
# The shapes of values.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
NUMBER_LEAD = r"(?<![\w.\-])[$€£₹]?\s?"
NUMBER = r"\d+(?:[.,]\d+)?"
NUMBER_TAIL = r"(?![\w@\-])"
TIMEZONE = r"\b[A-Z][A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?\b"
CURRENCY = r"\b[A-Z]{3}\b"
AFTER_KEYWORD = r"s?\b(?:\s+(?:id|number|no\.?|code))?\s*(?:is|was|=|:|to|of)?\s*#?\s*"
# Words that are never a value, that name secrets, that switch something, that lead in a message.
STOPWORDS = [
    "a", "an", "the", "my", "me", "is", "to", "for", "of", "and", "or", "with", "on", "in", "it", "this", "that", "be",
    "please", "id", "number", "no", "new", "current", "old", "from", "using", "use", "via", "by", "as", "at", "reset",
    "link", "code", "account",
]
SECRET_WORDS = ["password", "token", "otp", "secret", "pin", "code"]
SWITCH_WORDS = ["enabled", "enable", "is", "has", "allow", "on", "flag"]
LEAD_INS = ["that", "saying", "says", "say", "telling", "tell", "message", "text", "reading", "with"]

UNICODE = "(?U)"
ANY_CASE = "(?iuU)"
OPEN, CLOSE = "", ""  # private-use marks put around a match to find where it is
FIELD = "struct<field:string,type:string,format:string,enum:array<string>,required:boolean>"
SPAN = "struct<v:string,s:int,e:int>"
CLAIM = "struct<field:string,value:string,s:int,e:int>"


def _words_of(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def is_identifier(field: Column) -> Column:
    return let(word_parts(field), lambda w: (F.size(w) >= 2) & (F.element_at(w, -1) == "id"))


def is_secret(field: Column) -> Column:
    return F.arrays_overlap(word_parts(field), _words_of(SECRET_WORDS))


def looks_like_value(token: Column) -> Column:
    shape = token.rlike(r"(?U)\d") | token.rlike(r"[^A-Za-z]") | token.rlike(r"[a-z][A-Z]")
    return (token != "") & ~F.lower(token).isin(STOPWORDS) & shape


def clean_token(token: Column) -> Column:
    stripped = F.regexp_replace(F.regexp_replace(token, r"""[,;:?)"']+$""", ""), r"\.+$", "")
    return F.when(token.endswith("..."), token).otherwise(stripped)


def find_spans(text: Column, lead, value, tail="") -> Column:
    """ARRAY<STRUCT<v, s, e>> of every match of lead + value + tail: the value and its place."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (lead, value, tail)]
    flags, body = parts[0], parts[1]
    pattern = F.concat(flags, F.lit("("), body, F.lit(")"), parts[2])
    marked = F.regexp_replace(text, pattern, F.lit(f"$1{OPEN}$2{CLOSE}"))

    def step(acc: Column, piece: Column) -> Column:
        found = F.substring_index(piece, CLOSE, 1)
        span = F.struct(found.alias("v"), acc["pos"].alias("s"), (acc["pos"] + F.length(found)).alias("e"))
        return F.struct((acc["pos"] + F.length(piece) - 1).alias("pos"), F.concat(acc["found"], F.array(span)).alias("found"))

    def located(pieces: Column) -> Column:
        start = F.struct(F.length(pieces[0]).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("found"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces) - 1), start, step, lambda acc: acc["found"])

    # a text without a match is the common case and needs no further work
    return let(F.split(marked, OPEN), lambda p: F.when(F.size(p) > 1, located(p)).otherwise(F.array().cast(f"array<{SPAN}>")))


def _lead(pattern: str, flags: str = "") -> str:
    """Everything before the value, as the first group."""
    return f"{flags}({pattern})"


def keyword_spans(text: Column, words: Column, number: bool = False) -> Column:
    """Values right after a phrase, cleaned of sentence punctuation."""
    phrase = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    lead = F.concat(F.lit(ANY_CASE + r"(\b"), phrase, F.lit(AFTER_KEYWORD + ")"))
    raw = find_spans(text, lead, r"\d+(?:\.\d+)?" if number else r"\S+")
    if number:
        return raw
    cleaned = F.transform(raw, lambda h: let(clean_token(h["v"]), lambda t: F.struct(t.alias("v"), h["s"].alias("s"), (h["s"] + F.length(t)).alias("e"))))
    return F.filter(cleaned, lambda h: h["v"] != "")


def free(claims: Column, hit: Column) -> Column:
    return F.forall(claims, lambda c: (hit["e"] <= c["s"]) | (hit["s"] >= c["e"]))


def _claim(claims: Column, field: Column, value: Column, hit: Column) -> Column:
    entry = F.struct(field.alias("field"), value.alias("value"), hit["s"].alias("s"), hit["e"].alias("e"))
    return F.concat(claims, F.array(entry))


def _taken(claims: Column, field: Column) -> Column:
    return F.exists(claims, lambda c: c["field"] == field)


def _fold(fields: Column, claims: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(fields, claims, step)


def as_number(token: Column, kind: Column) -> Column:
    value = F.regexp_replace(token, ",", ".").cast("double")
    return F.when((kind == "integer") | (value == F.floor(value)), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


# --- phases ---------------------------------------------------------------------------------

def extract_emails(text: Column, fields: Column, claims: Column) -> Column:
    """One-to-one in order, only when addresses and e-mail fields are equally many."""
    wanted = F.filter(fields, lambda f: (f["format"] == "email") | (F.array_contains(word_parts(f["field"]), "email") & (f["type"] == "string")))

    def assign(pair: Column) -> Column:
        return F.when(
            (F.size(pair["w"]) > 0) & (F.size(pair["w"]) == F.size(pair["m"])),
            F.zip_with(pair["w"], pair["m"], lambda f, m: F.struct(f["field"].alias("field"), m["v"].alias("value"), m["s"].alias("s"), m["e"].alias("e"))),
        ).otherwise(claims)

    return let(F.struct(wanted.alias("w"), find_spans(text, _lead(""), EMAIL).alias("m")), assign)


def extract_identifiers(text: Column, fields: Column, claims: Column) -> Column:
    """The value after the field's own noun; it must hold a digit or a separator."""
    def step(state: Column, f: Column) -> Column:
        noun = F.slice(word_parts(f["field"]), 1, F.size(word_parts(f["field"])) - 1)
        hits = F.filter(keyword_spans(text, noun), lambda h: free(state, h) & looks_like_value(h["v"]) & h["v"].rlike(r"(?U)[\d_\-]"))
        return let(hits, lambda h: F.when(F.size(h) == 1, _claim(state, f["field"], h[0]["v"], h[0])).otherwise(state))

    return _fold(F.filter(fields, lambda f: is_identifier(f["field"]) & (f["type"] == "string")), claims, step)


def extract_secrets(text: Column, fields: Column, claims: Column) -> Column:
    """After the full name, else after the last word when no other field has it."""
    def step(state: Column, f: Column) -> Column:
        words = word_parts(f["field"])
        last = F.element_at(words, -1)
        shared = F.exists(fields, lambda o: (o["field"] != f["field"]) & F.array_contains(word_parts(o["field"]), last))

        def hits(phrase: Column) -> Column:
            return F.filter(keyword_spans(text, phrase), lambda h: free(state, h) & looks_like_value(h["v"]))

        def pick(h: Column) -> Column:
            second = let(hits(F.array(last)), lambda g: F.when(F.size(g) == 1, _claim(state, f["field"], g[0]["v"], g[0])).otherwise(state))
            return F.when(F.size(h) == 1, _claim(state, f["field"], h[0]["v"], h[0])).when(~shared, second).otherwise(state)

        return F.when(_taken(claims, f["field"]), state).otherwise(let(hits(words), pick))

    return _fold(F.filter(fields, lambda f: is_secret(f["field"]) & (f["type"] == "string")), claims, step)


def extract_enums(text: Column, fields: Column, claims: Column) -> Column:
    """Exactly one allowed option stands in the text as a word."""
    def step(state: Column, f: Column) -> Column:
        def named(option: Column) -> Column:
            quoted = F.concat(F.lit(r"\Q"), option, F.lit(r"\E"))
            found = F.filter(find_spans(text, ANY_CASE + r"(\b)", quoted, r"\b"), lambda h: free(state, h))
            return F.transform(found, lambda h: F.struct(option.alias("v"), h["s"].alias("s"), h["e"].alias("e")))

        hits = F.flatten(F.transform(f["enum"], named))
        one = let(hits, lambda h: F.when(
            F.size(F.array_distinct(F.transform(h, lambda x: x["v"]))) == 1, _claim(state, f["field"], h[0]["v"], h[0])
        ).otherwise(state))
        return F.when(_taken(state, f["field"]), state).otherwise(one)

    return _fold(F.filter(fields, lambda f: F.coalesce(F.size(f["enum"]), F.lit(0)) > 0), claims, step)


def extract_formats(text: Column, fields: Column, claims: Column) -> Column:
    """Time zones and currency codes, recognised by the field's name."""
    def step(state: Column, f: Column) -> Column:
        words = word_parts(f["field"])
        zone = F.array_contains(words, "timezone") | F.array_contains(words, "tz")
        spans = F.when(zone, find_spans(text, _lead("", UNICODE), TIMEZONE)).when(
            F.array_contains(words, "currency"), find_spans(text, _lead("", UNICODE), CURRENCY)
        )
        hits = F.filter(spans, lambda h: free(state, h))
        one = let(hits, lambda h: F.when(F.size(h) == 1, _claim(state, f["field"], h[0]["v"], h[0])).otherwise(state))
        return F.when(_taken(state, f["field"]) | spans.isNull(), state).otherwise(one)

    return _fold(F.filter(fields, lambda f: f["type"] == "string"), claims, step)


def _open_numbers(fields: Column, claims: Column) -> Column:
    return F.filter(fields, lambda f: f["type"].isin("integer", "number") & ~_taken(claims, f["field"]))


def extract_named_numbers(text: Column, fields: Column, claims: Column) -> Column:
    """The number beside the field's name."""
    def step(state: Column, f: Column) -> Column:
        hits = F.filter(keyword_spans(text, word_parts(f["field"]), number=True), lambda h: free(state, h))
        return let(hits, lambda h: F.when(F.size(h) == 1, _claim(state, f["field"], as_number(h[0]["v"], f["type"]), h[0])).otherwise(state))

    return _fold(_open_numbers(fields, claims), claims, step)


def extract_last_number(text: Column, fields: Column, claims: Column) -> Column:
    """One numeric field and one unclaimed number left: they belong together."""
    def assign(p: Column) -> Column:
        f, h = p["f"], p["h"]
        return F.when((F.size(f) == 1) & (F.size(h) == 1), _claim(claims, f[0]["field"], as_number(h[0]["v"], f[0]["type"]), h[0])).otherwise(claims)

    numbers = F.filter(find_spans(text, _lead(NUMBER_LEAD, UNICODE), NUMBER, NUMBER_TAIL), lambda h: free(claims, h))
    return let(F.struct(_open_numbers(fields, claims).alias("f"), numbers.alias("h")), assign)


PHASES = [
    extract_emails, extract_identifiers, extract_secrets, extract_enums, extract_formats, extract_named_numbers, extract_last_number,
]


# --- requests ---------------------------------------------------------------------------------

def with_fields(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Requests with the field list and the words of their template. The catalogue is the small side."""
    known = templates.select("t_id", "api_name", "endpoint", fields_array(F.col("json_schema")).alias("fields"))
    joined = requests.join(known, "t_id", "left")
    return joined.withColumn("fields", F.coalesce("fields", F.array().cast(f"array<{FIELD}>")))


def extract_by_rules(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Requests with ``claims``: ARRAY<STRUCT<field, value, s, e>> the rules could read off the text."""


    def run(phase: Callable) -> Column:
        # the claims so far are named once per phase: a filter pushed below would otherwise copy
        # the rules of all earlier phases for every mention
        return let(F.col("claims"), lambda c: phase(F.col("text"), F.col("fields"), c))

    df = with_fields(requests, templates).withColumn("claims", F.array().cast(f"array<{CLAIM}>"))
    for phase in PHASES:
        df = df.withColumn("claims", run(phase))
    return df


def rule_rows(extracted: DataFrame) -> DataFrame:
    """Long form: (request_id, field, value, source, confidence)."""
    # explode_outer, because explode adds a size filter that evaluates the rules a second time
    return extracted.select("request_id", F.explode_outer("claims").alias("c")).filter("c.field IS NOT NULL").select(
        "request_id", "c.field", "c.value", F.lit("rule").alias("source"), F.lit(RULE_CONFIDENCE).alias("confidence")
    )


def command_words(api_name: Column, endpoint: Column, fields: Column, claims: Column) -> Column:
    """Words that name the operation and its fields, and values already found."""
    return F.array_distinct(F.concat(
        word_parts(F.coalesce(api_name, F.lit(""))), alnum_words(F.coalesce(endpoint, F.lit(""))),
        F.flatten(F.transform(fields, lambda f: word_parts(f["field"]))), F.flatten(F.transform(claims, lambda c: alnum_words(c["value"]))),
    ))


def with_command(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("command", command_words(F.col("api_name"), F.col("endpoint"), F.col("fields"), F.col("claims")))


def unexplained_words(text: Column, command: Column) -> Column:
    """Words of the request nothing accounts for; none left means nothing else was said."""
    return F.array_sort(F.array_except(F.array_except(alnum_words(text), command), _words_of(STOPWORDS)))


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), r"""^[ .,!?;:"']+|[ .,!?;:"']+$""", "")


def refine_value(field: Column, value: Column, kind: Column, enum: Column, text: Column, command: Column) -> Column:
    """Snap a clipped single token to the whole one; drop a short heading, command words and lead-ins."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    tokens = F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), clean_token)
    snapped = let(F.filter(tokens, lambda t: (trimmed != "") & t.contains(trimmed)), lambda c: F.when(F.size(c) == 1, c[0]).otherwise(trimmed))
    head = F.substring_index(trimmed, ":", 1)
    tail = F.regexp_replace(F.substring(trimmed, F.length(head) + 2, F.length(trimmed)), r"(?U)^\s+|\s+$", "")
    short_head = F.size(F.filter(F.split(head, r"(?U)\s+"), lambda w: w != "")) <= 4
    body = F.when(trimmed.contains(":") & (tail != "") & short_head, tail).otherwise(trimmed)
    droppable = F.concat(command, _words_of(LEAD_INS))

    def drop(words: Column) -> Column:
        stays = F.transform(words, lambda w: ~F.array_contains(droppable, F.regexp_replace(F.lower(w), "[^a-z0-9]", "")))
        first = F.coalesce(F.array_position(stays, True), F.lit(0)).cast("int")
        start = F.when(first == 0, F.size(words)).otherwise(first)
        return F.when(F.size(words) > 0, F.array_join(F.slice(words, start, F.size(words)), " ")).otherwise("")

    free_text = let(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""), drop)
    plain = (kind == "string") & (F.coalesce(F.size(enum), F.lit(0)) <= 0)
    return F.when(~plain, value).when(is_secret(field) | is_identifier(field), snapped).otherwise(free_text)


def json_leaves(value: Column) -> Column:
    """Scalars inside JSON text, members' names left out."""
    # names are matched too, so that the search goes on behind them, and then left out
    quoted = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
    pairs = F.arrays_zip(
        F.regexp_extract_all(value, F.lit(quoted), 1).alias("text"), F.regexp_extract_all(value, F.lit(quoted), 2).alias("colon")
    )
    strings = F.transform(F.filter(pairs, lambda p: p["colon"] == ""), lambda p: p["text"])
    bare = F.regexp_extract_all(F.regexp_replace(value, r'"(?:[^"\\]|\\.)*"', '""'), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)"), 1)
    return F.concat(strings, bare)


def grounding_problem(field: Column, value: Column, kind: Column, format: Column, enum: Column, text: Column, command: Column) -> Column:
    """Why a proposed value cannot be accepted, or null when the request supports it."""
    q = normalise(text)
    q_words = alnum_words(q)
    subject = F.array_except(word_parts(field), _words_of(SWITCH_WORDS))
    mentioned = F.exists(subject, lambda w: F.array_contains(q_words, w) | F.array_contains(q_words, F.concat(w, F.lit("s"))))
    has_enum = F.coalesce(F.size(enum), F.lit(0)) > 0
    listed = F.concat(F.lit("not one of ['"), F.array_join(enum, "', '"), F.lit("']"))
    stated = F.transform(F.regexp_extract_all(F.regexp_replace(text, ",", "."), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda n: n.cast("double"))
    target = value.try_cast("double")
    leaves = F.transform(json_leaves(value), normalise)
    v = normalise(value)
    single = is_secret(field) | is_identifier(field) | F.coalesce(format == "email", F.lit(False))
    content = F.array_except(F.array_except(alnum_words(v), _words_of(STOPWORDS)), command)
    return (
        F.when(kind == "boolean", F.when(~mentioned, "the request doesn't mention it"))
        .when(has_enum, F.when(~F.array_contains(enum, value), listed).when(~F.array_contains(q_words, F.lower(value)), "inferred, not stated"))
        .when(kind.isin("integer", "number"), F.when(target.isNull(), "not a number").when(
            ~F.exists(stated, lambda n: F.abs(n - target) < 1e-9), "that number is not in the request"))
        .when(kind.isin("array", "object"), F.when(~F.exists(leaves, lambda x: (x != "") & q.contains(x)), "none of it appears in the request"))
        .when(F.coalesce(v, F.lit("")) == "", "empty")
        .when((v == q) & (F.size(F.split(q, " ")) > 2), "the model copied the whole request")
        .when(single & v.contains(" "), "a single value was expected, not a phrase")
        .when(F.coalesce(format == "email", F.lit(False)) & ~F.trim(value).rlike(f"^(?:{EMAIL})$"), "not an email address")
        .when(~q.contains(v), "not in the request")
        .when(F.size(content) == 0, "only repeats the command")
    )


def _proposed(proposals: DataFrame) -> DataFrame:
    """One row per request: its proposals as a list, one value per field (the smallest of several), absent ones left out."""
    given = proposals.filter(~is_absent(F.col("value")) & ~F.trim("value").isin("[]", "{}"))
    each = given.groupBy("request_id", "field").agg(F.min("value").alias("value"))
    return each.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("_proposed"))


def _judged(proposed: Column, text: Column, fields: Column, claims: Column, command: Column) -> Column:
    """ARRAY<STRUCT<field, value, confidence, problem>>: each proposal for a field still open, refined and held against the text."""

    def judge(f: Column, p: Column) -> Column:
        def verdict(c: Column) -> Column:
            refined = refine_value(f["field"], c["value"], f["type"], f["enum"], text, command)
            return let(refined, lambda v: F.struct(
                f["field"].alias("field"), v.alias("value"), F.when(f["type"] == "boolean", INFERRED_CONFIDENCE).otherwise(GROUNDED_CONFIDENCE).alias("confidence"),
                F.coalesce(c["problem"], grounding_problem(f["field"], v, f["type"], f["format"], f["enum"], text, command)).alias("problem"),
            ))

        return let(typed_coerce(p["value"], f["type"]), verdict)

    wanted = F.filter(proposed, lambda p: F.exists(fields, lambda f: f["field"] == p["field"]) & ~_taken(claims, p["field"]))
    return F.transform(wanted, lambda p: let(F.filter(fields, lambda f: f["field"] == p["field"])[0], lambda f: judge(f, p)))


def with_judgement(extracted: DataFrame, proposals: DataFrame, how: str = "left") -> DataFrame:
    """
    ``extracted`` with ``judged``, its proposals' verdicts. Only fields the rules left open, of requests with unexplained words.

    Proposals are gathered per request first, so the requests, and the rules read off them, are needed once.
    """
    asked = with_command(extracted.join(_proposed(proposals), "request_id", how))
    empty = F.array().cast("array<struct<field:string,value:string,confidence:double,problem:string>>")
    open_words = F.size(unexplained_words(F.col("text"), F.col("command"))) > 0
    verdicts = F.when(F.col("_proposed").isNotNull() & open_words, _judged(*map(F.col, ("_proposed", "text", "fields", "claims", "command"))))
    return asked.withColumn("judged", F.coalesce(verdicts, empty)).drop("_proposed", "command")


def ground_proposals(extracted: DataFrame, proposals: DataFrame) -> DataFrame:
    """
    Proposed values (request_id, field, value) refined and judged: (request_id, field, value, confidence, problem). Only
    fields the rules left open, of requests with unexplained words; of several values for one field the smallest counts.
    """
    rows = with_judgement(extracted, proposals, "inner").select("request_id", F.explode_outer("judged").alias("j"))
    return rows.filter("j.field IS NOT NULL").select("request_id", "j.*")


STRATEGIES = ("hybrid", "rules", "proposals")


def assemble_extraction(extracted: DataFrame, proposals: DataFrame | None = None, strategy: str | None = None) -> DataFrame:
    """
    One row per request: values, each field's value, source and confidence, weakest confidence, missing required fields,
    unverified proposals, ok and strategy.

    ``hybrid``: rules win, proposals for what they left open are held against the text. ``rules``: proposals are not read.
    ``proposals``: they alone, coerced to the type of their field but not held against the text, without a confidence; one
    that cannot be coerced makes ``ok`` false. Without a strategy it is hybrid, and the row says ``hybrid`` or ``rules`` by
    whether a proposal was judged. A request without fields is ok and empty.
    """
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if proposals is None:
        proposals = extracted.sparkSession.createDataFrame([], "request_id bigint, field string, value string")
    found = "array<struct<field:string,value:string,source:string,confidence:double>>"

    def entries(values: str | Column, source: str, confidence) -> Column:
        return F.transform(values, lambda v: F.struct(
            v["field"].alias("field"), v["value"].alias("value"), F.lit(source).alias("source"), confidence(v).cast("double").alias("confidence"))).cast(found)

    ruled = entries("claims", "rule", lambda c: F.lit(RULE_CONFIDENCE))
    none = F.array().cast("array<struct<field:string,value:string,confidence:double,problem:string>>")
    if strategy == "rules":
        df = extracted.withColumns({"judged": none, "_found": ruled})
    elif strategy == "proposals":
        df = extracted.drop("claims").join(_proposed(proposals), "request_id", "left")
        known = F.filter(F.coalesce("_proposed", F.array().cast("array<struct<field:string,value:string>>")), lambda p: F.exists("fields", lambda f: f["field"] == p["field"]))
        kind = lambda p: F.filter("fields", lambda f: f["field"] == p["field"])[0]["type"]
        coerced = F.transform(known, lambda p: let(typed_coerce(p["value"], kind(p)), lambda c: F.struct(
            p["field"].alias("field"), c["value"].alias("value"), F.lit(None).cast("double").alias("confidence"), c["problem"].alias("problem"))))
        df = df.withColumn("judged", coerced).withColumn("_found", entries(F.filter("judged", lambda j: j["problem"].isNull()), "proposal", lambda j: j["confidence"]))
    else:
        df = with_judgement(extracted, proposals)
        df = df.withColumn("_found", F.concat(ruled, entries(F.filter("judged", lambda j: j["problem"].isNull()), "proposal", lambda j: j["confidence"])))
    names = F.transform("_found", lambda f: f["field"])
    missing = F.array_except(F.transform(F.filter("fields", lambda f: f["required"]), lambda f: f["field"]), names)
    unverified = F.transform(F.filter("judged", lambda j: j["problem"].isNotNull()), lambda b: F.struct(b["field"].alias("field"), b["value"].alias("value"), b["problem"].alias("reason")))
    ok = (F.size(missing) == 0) & (F.size(unverified) == 0) if strategy == "proposals" else F.size(missing) == 0
    return df.select(
        "request_id", "t_id", F.map_from_entries(F.transform("_found", lambda f: F.struct(f["field"], f["value"]))).alias("values"),
        F.map_from_entries(F.transform("_found", lambda f: F.struct(f["field"], F.struct(f["value"], f["source"], f["confidence"])))).alias("fields"),
        F.array_min(F.transform("_found", lambda f: f["confidence"])).alias("confidence"), missing.alias("missing_required"),
        unverified.alias("unverified"), ok.alias("ok"),
        F.lit(strategy).alias("strategy") if strategy else F.when(F.size("judged") > 0, "hybrid").otherwise("rules").alias("strategy"),
    )


def validate_bodies(bodies: DataFrame, templates: DataFrame) -> DataFrame:
    """
    Proposed bodies (request_id, t_id, body MAP<STRING, STRING>) against the schema: absent values
    and unknown keys dropped, values coerced, required fields checked. On failure the known
    values are kept as given.
    """
    df = with_fields(bodies.withColumn("text", F.lit("")), templates)
    kinds = F.map_from_arrays(F.transform("fields", lambda f: f["field"]), F.transform("fields", lambda f: f["type"]))
    df = df.withColumn("_kinds", kinds)
    df = df.withColumn("_known", F.map_filter("body", lambda k, v: F.map_contains_key(F.col("_kinds"), k) & ~is_absent(v)))
    df = df.withColumn("_typed", F.transform_values("_known", lambda k, v: typed_coerce(v, F.col("_kinds")[k])))
    problems = F.filter(F.map_entries("_typed"), lambda e: e["value"]["problem"].isNotNull())
    required = F.transform(F.filter("fields", lambda f: f["required"]), lambda f: f["field"])
    missing = F.array_except(required, F.map_keys("_known"))
    ok = (F.size(problems) == 0) & (F.size(missing) == 0)
    return df.select(
        "request_id", "t_id", ok.alias("ok"),
        F.when(ok, F.transform_values("_typed", lambda k, v: v["value"])).otherwise(F.col("_known")).alias("values"),
        missing.alias("missing_required"),
        F.transform(problems, lambda e: F.concat(e["key"], F.lit(": "), e["value"]["problem"])).alias("problems"),
    )
