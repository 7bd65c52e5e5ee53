"""The API catalogue: schema fields, validation, approval status and joins onto it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.scoping import equality_filters
from waymark.session import checkpointed

# Least size of each part of a template, and the approval states.
MIN_DESCRIPTION_WORDS = 500
MIN_SAMPLES = 3
STATUSES = ["draft", "review", "approved", "rejected"]


def _type_of(spec: Column) -> Column:
    """Declared type; the first one that is not "null" when a list is given."""
    raw = F.get_json_object(spec, "$.type")
    many = F.filter(F.from_json(raw, "array<string>"), lambda t: t != "null")
    return F.coalesce(F.when(raw.rlike(r"^\s*\["), F.try_element_at(many, F.lit(1))).otherwise(raw), F.lit("string"))


def _members(schema: Column) -> Column:
    """The fields a schema declares itself: name, spec (its text) and whether it is required."""
    members = F.map_entries(F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>"))
    required = F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))
    return F.transform(members, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.array_contains(required, e["key"]).alias("required")))


def _declared(path: Column, spec: Column, required: Column) -> Column:
    return F.struct(
        path.alias("field"), _type_of(spec).alias("type"), F.get_json_object(spec, "$.format").alias("format"),
        F.from_json(F.get_json_object(spec, "$.enum"), "array<string>").alias("enum"), required.alias("required"),
    )


def fields_array(schema: Column) -> Column:
    """ARRAY<STRUCT<field, type, format, enum, required>> of the fields a JSON Schema text declares at its top."""
    empty = "array<struct<field:string,type:string,format:string,enum:array<string>,required:boolean>>"
    return F.coalesce(F.transform(_members(schema), lambda m: _declared(m["name"], m["spec"], m["required"])), F.array().cast(empty))


def schema_fields(templates: DataFrame, depth: int | None = None) -> DataFrame:
    """
    One row per field of each template's request schema, in declared order, at every depth or down to ``depth``.

    Schemas are walked level by level: the rows of one level are the nested schemas found in the one before, kept in the
    shared folder, so the plan of a level is the same however deep it lies. A field is followed by the fields inside it.
    """
    level = templates.select(
        "t_id", F.monotonically_increasing_id().alias("_row"), F.col("json_schema").alias("_schema"), F.lit("").alias("_prefix"), F.array().cast("array<int>").alias("_place")
    )
    levels: list[DataFrame] = []
    while depth is None or len(levels) < max(depth, 1):
        each = level.select("t_id", "_row", "_prefix", "_place", F.posexplode(_members(F.col("_schema"))).alias("_n", "_m"))
        path, spec = F.concat("_prefix", "_m.name"), F.col("_m.spec")
        found = checkpointed(each.select(
            "t_id", "_row", F.concat("_place", F.array("_n")).alias("_place"), spec.alias("_spec"), _declared(path, spec, F.col("_m.required")).alias("f")
        ))
        if levels and found.isEmpty():
            break
        levels.append(found)
        items = (F.col("f.type") == "array") & (F.get_json_object("_spec", "$.items.type") == "object")
        nested = found.filter((F.col("f.type") == "object") | items)
        level = nested.select(
            "t_id", "_row", F.when(items, F.get_json_object("_spec", "$.items")).otherwise(F.col("_spec")).alias("_schema"),
            F.concat("f.field", F.when(items, "[].").otherwise(".")).alias("_prefix"), "_place",
        )
    order = W.partitionBy("_row").orderBy("_place")
    rows = reduce(DataFrame.unionByName, levels).withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.select("t_id", "ordinal", "f.*")


def validate_templates(templates: DataFrame) -> DataFrame:
    """
    One row per broken rule: (t_id, field, error). Wants description, sample_requests and
    sample_responses (arrays of JSON text), n_parameters, domain_tags, json_schema.
    """
    words = F.size(F.filter(F.split(F.coalesce("description", F.lit("")), r"\s+"), lambda w: w != ""))

    def size(name: str) -> Column:
        return F.coalesce(F.size(F.col(name)), F.lit(0))

    def rule(broken: Column, field: str, *error) -> Column:
        text = F.concat(*[e if isinstance(e, Column) else F.lit(e) for e in error])
        return F.when(broken, F.struct(F.lit(field).alias("field"), text.alias("error")))

    requests, responses = F.greatest(size("sample_requests"), F.lit(0)), F.greatest(size("sample_responses"), F.lit(0))
    scenarios = F.filter(F.transform("sample_requests", lambda s: F.get_json_object(s, "$.scenario")), lambda s: s.isNotNull())
    schema_type = F.get_json_object("json_schema", "$.type")
    rules = [
        rule(words < MIN_DESCRIPTION_WORDS, "description", "Description has only ", words.cast("string"), " words (minimum 500 required)"),
        rule(requests < MIN_SAMPLES, "sample_requests", "Only ", requests.cast("string"), " sample requests (minimum 3 required)"),
        rule(responses < MIN_SAMPLES, "sample_responses", "Only ", responses.cast("string"), " sample responses (minimum 3 required)"),
        rule(F.coalesce("n_parameters", F.lit(0)) < 1, "parameters", "No parameters defined (minimum 1 required)"),
        rule(F.greatest(size("domain_tags"), F.lit(0)) < 1, "domain_tags", "No domain tags specified (minimum 1 required)"),
        rule(F.coalesce(schema_type, F.lit("")) == "", "json_schema", "JSON Schema missing 'type' field"),
        rule((F.size(scenarios) > 0) & ~F.array_contains(scenarios, "valid"), "sample_requests", "No sample request has scenario 'valid'"),
        rule(
            (schema_type == "object") & F.get_json_object("json_schema", "$.properties").isNull(),
            "json_schema", "JSON Schema with type 'object' must include 'properties'",
        ),
    ]
    broken = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return templates.select("t_id", F.explode(broken).alias("r")).select("t_id", "r.*")


def required_parameters_missing(params: DataFrame, requests: DataFrame) -> DataFrame:
    """Required parameter names of the request's template absent from its ``values`` map."""
    # grouped by template: a template has a handful of parameters
    wanted = params.filter("is_required").groupBy("t_id").agg(F.collect_set("name").alias("wanted"))
    missing = F.array_sort(F.array_except("wanted", F.coalesce(F.map_keys("values"), F.array().cast("array<string>"))))
    joined = requests.join(wanted, "t_id", "left")
    return joined.select("request_id", "t_id", F.coalesce(missing, F.array().cast("array<string>")).alias("missing"))


def templates_by_status(templates: DataFrame, metadata: DataFrame, status: str | None = None) -> DataFrame:
    """With a status: templates whose metadata has it. Without one: all templates."""
    if status is None:
        return templates
    return templates.join(equality_filters(metadata, status=status).select("t_id", "status"), "t_id")


def template_status_counts(templates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Total and one count per status in a single pass."""
    status = metadata.select("t_id", "status")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return templates.join(status, "t_id", "left").agg(F.count("*").alias("total_templates"), *counts)


def datasets_with_template(datasets: DataFrame, templates: DataFrame) -> DataFrame:
    """Template name beside each dataset (left outer), and where the rows came from."""
    names = templates.select("t_id", F.col("api_name").alias("template_name"))
    source = F.when(F.col("generated_with_llm"), "AI_GENERATED").otherwise("CSV_UPLOAD")
    return datasets.join(names, "t_id", "left").withColumn("source_type", source)


def resolve_template(ranked: DataFrame, templates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Catalogue row of each winner; ``endpoint`` falls back to the legacy field; ``error`` when it is gone."""
    known = templates.select(
        *(keys or ["t_id"]), F.col("api_name").alias("resolved_api"),
        F.coalesce("endpoint", "legacy_field").alias("resolved_endpoint"), F.col("method").alias("resolved_method"), F.lit(True).alias("_known"),
    )
    joined = ranked.join(known, keys or ["t_id"], "left")
    return joined.withColumn("error", F.when(F.col("_known").isNull(), "TEMPLATE_NOT_FOUND")).drop("_known")


def route_ids(rows: DataFrame, datasets: DataFrame, templates: DataFrame) -> DataFrame:
    """Template of each row: its dataset's, else the one its ``api_name`` names. ``unroutable`` marks the rest."""
    by_dataset = datasets.select("dataset_id", F.col("t_id").alias("_dataset_t"))
    # a name that occurs twice resolves to the last template of that name
    by_name = templates.filter(F.col("api_name").isNotNull() & (F.col("api_name") != "")).groupBy("api_name").agg(F.max("t_id").alias("_name_t"))
    joined = rows.join(by_dataset, "dataset_id", "left").join(by_name, "api_name", "left")
    t_id = F.coalesce("_dataset_t", "_name_t")
    return joined.withColumn("t_id", t_id).withColumn("unroutable", t_id.isNull()).drop("_dataset_t", "_name_t")
