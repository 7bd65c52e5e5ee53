"""The model catalogue: merging a listing into it, retiring, deleting and showing it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How long a model may be missing, stay retired, and count as new.
RETIRE_GRACE = dt.timedelta(hours=72)
RETIRED_RETENTION = dt.timedelta(days=7)
NEW_BADGE = dt.timedelta(days=7)
BOOTSTRAP_MARGIN = dt.timedelta(minutes=5)
GLOBAL = "global"
GROUP = ["scope", "provider"]


def merge_listings(listings: DataFrame, order: str = "listing_no") -> DataFrame:
    """Union of several listings of a group; the first occurrence of a model wins."""
    row = F.struct(*[F.col(c) for c in listings.columns])
    return listings.groupBy(*GROUP, "model_id").agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def distinct_groups(df: DataFrame) -> DataFrame:
    return df.select(*GROUP).distinct()


def exclude_shared(personal: DataFrame, shared: DataFrame, signature: list[str] | None = None) -> DataFrame:
    """Personal credentials that reach nothing a shared one already lists."""
    keys = signature or ["provider", "api_key", "base_url"]
    clean = {"base_url": F.regexp_replace(F.coalesce("base_url", F.lit("")), "/+$", "")}

    def signed(df: DataFrame) -> DataFrame:
        return df.withColumn("_sig", F.struct(*[clean.get(k, F.coalesce(F.col(k), F.lit(""))).alias(k) for k in keys]))

    return signed(personal).join(signed(shared).select("_sig").distinct(), "_sig", "left_anti").drop("_sig")


def sync_catalog(existing: DataFrame, listing: DataFrame, groups: DataFrame, now: dt.datetime) -> DataFrame:
    """
    Next state of the catalogue after one round of listings.

    ``groups`` has one row per listed (scope, provider): ``listed_ok`` says at least one
    listing arrived, ``failures`` how many failed. Nothing changes without a listing; a
    failure keeps unseen models as they are. ``transition`` names what happened to each row.
    """
    at = F.lit(now)
    seen = listing.select(*GROUP, "model_id", F.col("kind").alias("_kind"), "shutdown_date", F.lit(True).alias("_seen"))
    merged = existing.join(seen, [*GROUP, "model_id"], "full_outer").join(
        groups.select(*GROUP, "listed_ok", "failures"), GROUP, "left"
    )
    listed = F.coalesce("listed_ok", F.lit(False))
    is_seen = F.col("_seen").isNotNull()
    known = F.col("status").isNotNull()
    gone = is_seen & F.coalesce(F.col("shutdown_date") <= F.to_date(at), F.lit(False))
    unseen = ~is_seen & (F.coalesce("failures", F.lit(0)) == 0)
    expired = (F.col("status") == "deprecated") & (F.col("missing_since") <= F.lit(now - RETIRE_GRACE))
    transition = (
        F.when(~listed, F.when(known, "unchanged"))
        .when(is_seen & ~known, F.when(gone, "added_retired").otherwise("added"))
        .when(gone, "retired")
        .when(is_seen, "active")
        .when(unseen & (F.col("status") == "active"), "deprecated")
        .when(unseen & F.coalesce(expired, F.lit(False)), "retired")
        .otherwise("unchanged")
    )
    step = F.col("transition")
    retiring = step.isin("retired", "added_retired")
    out = merged.withColumn("transition", transition).filter(step.isNotNull())
    return out.select(
        *GROUP, "model_id",
        F.when(listed & is_seen, F.col("_kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(retiring, "retired").when(step.isin("added", "active"), "active").when(step == "deprecated", "deprecated")
        .otherwise(F.col("status")).alias("status"),
        F.when(listed & is_seen, None).when(step == "deprecated", at).otherwise(F.col("missing_since")).alias("missing_since"),
        F.when(retiring & ~F.coalesce(F.col("status") == "retired", F.lit(False)), at).when(step.isin("added", "active"), None)
        .otherwise(F.col("retired_at")).alias("retired_at"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"),
        "transition",
    )


def transition_counts(synced: DataFrame) -> DataFrame:
    return synced.groupBy(*GROUP, "transition").agg(F.count("*").alias("n"))


def retire_orphans(catalog: DataFrame, live_groups: DataFrame, now: dt.datetime) -> DataFrame:
    """Models no live credential can reach become retired; others stay."""
    live = live_groups.select(*GROUP).distinct().withColumn("_live", F.lit(True))
    joined = catalog.join(live, GROUP, "left")
    orphan = F.col("_live").isNull() & (F.col("status") != "retired")
    return joined.withColumns({
        "retired_at": F.when(orphan, F.lit(now)).otherwise(F.col("retired_at")),
        "status": F.when(orphan, "retired").otherwise(F.col("status")),
    }).drop("_live")


def live_sources(sources: DataFrame, live_groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sync records of groups that are live or still have models."""
    kept = live_groups.select(*GROUP).unionByName(catalog.select(*GROUP)).distinct()
    return sources.join(kept, GROUP, "left_semi")


def _deletable(now: dt.datetime) -> Column:
    return (F.col("status") == "retired") & (F.col("retired_at") <= F.lit(now - RETIRED_RETENTION))


def referenced_models(connections: DataFrame, datasets: DataFrame, settings: DataFrame) -> DataFrame:
    """
    References as (kind, ref_provider, ref_model, ref_scope): a language model is referenced by
    a connection of its provider, an embedding model by name from a dataset or a setting,
    with or without the ``:latest`` suffix.
    """
    llm = connections.select(F.lit("llm").alias("kind"), F.col("provider").alias("ref_provider"), F.col("model_name").alias("ref_model"), "u_id")
    names = datasets.select("embedding_model", "u_id").unionByName(
        settings.select(F.col("default_embedding_model").alias("embedding_model"), "u_id")
    ).filter(F.col("embedding_model").isNotNull())
    # "x:latest" refers to both "x:latest" and "x"
    both = F.array_distinct(F.array("embedding_model", F.regexp_replace("embedding_model", ":latest$", "")))
    emb = names.select(F.lit("embedding").alias("kind"), F.lit(None).cast("string").alias("ref_provider"), F.explode(both).alias("ref_model"), "u_id")
    refs = llm.unionByName(emb)
    # a global model may be used by anyone, a personal one only by its owner
    scopes = F.explode(F.array(F.lit(GLOBAL), F.col("u_id")))
    return refs.select("kind", "ref_provider", "ref_model", scopes.alias("ref_scope")).distinct()


def delete_unused_retired(catalog: DataFrame, references: DataFrame, now: dt.datetime) -> DataFrame:
    """The catalogue without long-retired models that nothing refers to."""
    keyed = catalog.withColumn("_provider", F.when(F.col("kind") == "llm", F.col("provider")).otherwise(F.lit("")))
    refs = references.select(
        "kind", F.coalesce("ref_provider", F.lit("")).alias("_provider"), F.col("ref_model").alias("model_id"),
        F.col("ref_scope").alias("scope"), F.lit(True).alias("_used"),
    ).distinct()
    joined = keyed.join(refs, ["kind", "_provider", "model_id", "scope"], "left")
    doomed = F.coalesce(_deletable(now), F.lit(False)) & F.col("_used").isNull()
    return joined.filter(~doomed).drop("_provider", "_used")


def visible_catalog(catalog: DataFrame, user: str, include_retired: bool = False, **filters) -> DataFrame:
    """Shared models and the user's own, each (provider, model) once, the shared entry preferred."""
    from waymark.operators.scoping import equality_filters

    rows = equality_filters(catalog.filter(F.col("scope").isin(GLOBAL, user)), **filters)
    if not include_retired:
        rows = rows.filter(F.col("status") != "retired")
    order = W.partitionBy("provider", "model_id").orderBy((F.col("scope") == GLOBAL).desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def new_model_badge(catalog: DataFrame, sources: DataFrame, now: dt.datetime) -> DataFrame:
    """Seen later than five minutes after the source's first success, and within the last week."""
    joined = catalog.join(sources.select(*GROUP, "first_success_at"), GROUP, "left")
    start = F.coalesce("first_success_at", "first_seen_at")
    after = F.unix_micros("first_seen_at") > F.unix_micros(start) + int(BOOTSTRAP_MARGIN.total_seconds() * 1e6)
    recent = F.col("first_seen_at") > F.lit(now - NEW_BADGE)
    return joined.withColumn("is_new", after & recent).drop("first_success_at")
