"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.session import prepare, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to work on, spread by its first column if it is in few splits."""
    df = table(spark, sf_dir, name)
    return spread(df, df.columns[0])


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``oracle`` may use role placeholders."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            from waymark.plans.roles import expand

            ORACLES[name] = re.sub(r"\n\s*\n", "\n", expand(oracle)).strip()
        return fn

    return register
