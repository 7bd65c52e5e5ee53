"""Shared pieces: stored intermediates, joins that stand hot keys, text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import fresh_path

# White space as Unicode defines it, for the body of a character class.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HEAVY_SHARE = 1000


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text alone (null: empty), whatever other columns there are."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(key: str, folds: int):
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def lookup(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """
    Left join of ``rows`` to ``facts``, which has one row per ``key`` and the number of rows it stands for.

    A key that stands for over 1/HEAVY_SHARE of all is one of fewer than HEAVY_SHARE such keys, which
    bounds their broadcast; the rows they match are scattered in the shuffle of the others.
    ``facts`` is read three times: store it first. Keys must be free of nulls.
    """
    names = [c for c in facts.columns if c != key]
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    limit = total / HEAVY_SHARE
    hot = facts.filter(F.col(count) > limit).select(key, F.struct(*names).alias("_hot"))
    cold = facts.filter(F.col(count) <= limit).select(key, F.lit(0).alias("_salt"), F.struct(*names).alias("_cold"))
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(100_003)).cast("int"))
    joined = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", spread).join(cold.hint("merge"), [key, "_salt"], "left")
    found = reduce(lambda d, n: d.withColumn(n, F.coalesce(F.col(f"_hot.{n}"), F.col(f"_cold.{n}"))), names, joined)
    return found.drop("_hot", "_cold", "_salt")
