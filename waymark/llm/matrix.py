"""
A sparse document-term matrix in shards, and the audit of how text filters overlap.

Each task cuts its texts into words and keeps them as compressed sparse rows over a dictionary of its own: per shard
the words met, and per document which of them it holds and how often. One global dictionary is made of the shards'
dictionaries, so a word is shuffled once per shard that holds it and not once per document, packed with the others of its
bucket; it gives back the numbers by which each shard's columns are renamed. A shard closes at ``most`` bytes of words and their numbers, and one
document more.

The audit reads words and distinct words of a document from the sums and the entry counts of its row, adds the
flags that need no words, counts documents by the set of filters they fail, and answers every order of the
filters from those at most 32 counts per part.

Null texts are empty: no words, so they fail the filter for short texts alone, and that for copies if a smaller id is
empty too. A null id is neither smaller nor larger than any. Rows that repeat an id are documents each; where
labels repeat an id, one that says 1 is enough. A null part is the empty string. Other columns are not read. An empty
table gives no shard, no word and no row.
"""

from __future__ import annotations

import json
import uuid
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.llm.common import lookup, stored
from waymark.operators.terms import bucket_words, dealt_words, packed

FILTERS = "ABCDE"
BUCKET_WORDS = 400_000
ENTRY_WORDS = 1 << 16
MOST = 96 << 20
# Bytes that the numbers of one word take while a shard is put together.
WORD_COST = 40


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and how many each text has."""
    # White space of ASCII is exactly \x20 and \x09-\x0D. Text that begins or ends in it gives an empty word there.
    pieces = pc.ascii_split_whitespace(texts.view(pa.string()))
    words, starts = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    real = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(real)).view(pa.binary()), np.diff(np.r_[0, np.cumsum(real)][starts])


def _entries(codes: np.ndarray, sizes: np.ndarray, n_words: int):
    """
    Where each document's entries begin, and their words and counts, from the words of all documents in turn. Documents
    of about ENTRY_WORDS words are sorted at a time, so numbers of eight bytes are held for those alone.
    """
    ends = np.r_[0, np.cumsum(sizes)]
    n_entries, parts, begin = [np.zeros(1, np.int64)], [], 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ENTRY_WORDS, "right")) - 1)
        # Row and column in one number; equal ones lie together once sorted.
        numbers = np.repeat(np.arange(end - begin), sizes[begin:end]) * n_words + codes[ends[begin] : ends[end]]
        entries, counts = np.unique(numbers, return_counts=True)
        rows, words = np.divmod(entries, max(n_words, 1))
        n_entries.append(np.bincount(rows, minlength=end - begin))
        parts.append((words.astype("<i4"), counts.astype("<i4")))
        begin = end
    return np.cumsum(np.concatenate(n_entries)), [np.concatenate(x) for x in zip(*parts)]


def _sparse(batches, most, tag_type):
    def flush():
        nonlocal held, size
        words, sizes, tags = (list(column) for column in zip(*held))
        held, size = [], 0
        coded = pa.concat_arrays(words).dictionary_encode()
        del words
        sizes, n_words = np.concatenate(sizes), len(coded.dictionary)
        indptr, (indices, data) = _entries(coded.indices.to_numpy(), sizes, n_words)
        indptr = indptr.astype("<i8").tobytes()
        entries = [coder.compress(x.tobytes()) for x in (indices, data)]
        one = [pa.array([x], pa.binary()) for x in (uuid.uuid4().bytes, *packed(coded.dictionary), indptr, *entries)]
        return pa.RecordBatch.from_arrays([*one, listed(pa.concat_arrays(tags).cast(tag_type))], ["shard", "words", "lengths", "indptr", "indices", "data", "tags"])

    def listed(values):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    coder = zstandard.ZstdCompressor(level=1)
    held, size = [], 0
    for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        words, sizes = _split_words(part.column("text"))
        # A word's bytes and, beside them, what its numbers take.
        ends = np.cumsum(sizes)
        cost = np.cumsum(np.diff(np.r_[0, np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)][np.r_[0, ends]]) + WORD_COST * sizes + WORD_COST)
        begin, paid = 0, 0
        while begin < len(sizes):
            # With the document that reaches the limit.
            end = min(len(sizes), 1 + int(np.searchsorted(cost, paid + most - size)))
            first = ends[begin - 1] if begin else 0
            held.append((words.slice(first, ends[end - 1] - first), sizes[begin:end], part.column("tag").slice(begin, end - begin)))
            size, begin, paid = size + int(cost[end - 1]) - paid, end, int(cost[end - 1])
            if size >= most:
                yield flush()
                pa.default_memory_pool().release_unused()
    if held:
        yield flush()
    # A worker outlives its task and waits beside others' heaps.
    pa.default_memory_pool().release_unused()


def _numbered(key, table, buckets):
    """For each shard in the bucket the numbers of its words."""
    rank, _, sizes = bucket_words(table)
    ids, ends = rank * buckets + key[0].as_py(), np.r_[0, np.cumsum(sizes)]
    return pa.table({
        "shard": table["shard"], "places": table["places"],
        "word_ids": pa.array([ids[a:b].astype("<i8").tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
    })


def _listed_words(key, table, buckets):
    _, words, _ = bucket_words(table)
    return pa.table({"word": words.cast(pa.binary()), "word_id": pa.array(np.arange(len(words)) * buckets + key[0].as_py(), pa.int64())})


def _renamed(batches):
    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(batch.num_rows):
            # One shard at a time.
            named, indices, data = (batch.column(c)[at] for c in ("named", "indices", "data"))
            parts = [[np.frombuffer(x, k) for x in named.values.field(f).to_pylist()] for f, k in (("places", "<i4"), ("word_ids", "<i8"))] if named.is_valid else [[], []]
            names = np.zeros(sum(map(len, parts[0])), "<i8")
            for places, word_ids in zip(*parts):
                names[places] = word_ids
            indices = names[np.frombuffer(coder.decompress(indices.as_py()), "<i4")].tobytes()
            one = batch.slice(at, 1)
            kept = [one.column(c) for c in ("shard", "indptr", "tags")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([indices], pa.binary()), pa.array([coder.decompress(data.as_py())], pa.binary())], ["shard", "indptr", "tags", "indices", "data"]
            )


def document_terms(docs: DataFrame, tag: Column, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """
    The matrix of ``text``, whose rows carry ``tag``, and its dictionary.

    Shards: shard, indptr (64-bit), indices (64-bit word numbers), data (32-bit counts), all little-endian, and tags,
    one per row. Dictionary: word and word_id. Both are read off the stored shards of local words.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), tag.alias("tag"))
    tags = rows.schema["tag"].dataType
    local = stored(
        rows.mapInArrow(
            partial(_sparse, most=most, tag_type=to_arrow_type(tags)),
            f"shard binary, words binary, lengths binary, indptr binary, indices binary, data binary, tags array<{tags.simpleString()}>",
        ), "sparse", codec="zstd",
    )
    # A word's number: its rank among the words of its bucket, and the bucket. One shuffle deals words to buckets of bounded size.
    buckets = max(1, -(-(local.agg(F.sum(F.octet_length("lengths").cast("long"))).first()[0] or 0) // (4 * BUCKET_WORDS)))
    dealt = local.select("shard", "words", "lengths").mapInArrow(partial(dealt_words, buckets=buckets), "bucket long, shard binary, words binary, lengths binary, places binary")

    # Named functions: Spark looks at their parameters.
    def numbered(key, table):
        return _numbered(key, table, buckets)

    def listed(key, table):
        return _listed_words(key, table, buckets)

    dictionary = dealt.groupBy("bucket").applyInArrow(listed, "word binary, word_id long")
    named = dealt.groupBy("bucket").applyInArrow(numbered, "shard binary, places binary, word_ids binary")
    named = named.groupBy("shard").agg(F.collect_list(F.struct("places", "word_ids")).alias("named"))
    shards = local.select("shard", "indptr", "indices", "data", "tags").join(named, "shard", "left").mapInArrow(
        _renamed, f"shard binary, indptr binary, tags array<{tags.simpleString()}>, indices binary, data binary"
    )
    return shards, dictionary


def _row_sums(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            indptr, data = (np.frombuffer(batch.column(c)[at].as_py(), k) for c, k in (("indptr", "<i8"), ("data", "<i4")))
            sums = np.r_[0, np.cumsum(data, dtype=np.int64)][indptr]
            yield pa.RecordBatch.from_arrays([batch.column("tags")[at].values, pa.array(np.diff(sums)), pa.array(np.diff(indptr))], ["tag", "words", "distinct_words"])


def row_sums(shards: DataFrame) -> DataFrame:
    """tag, words and distinct_words of every row of the matrix."""
    tags = shards.schema["tags"].dataType.elementType.simpleString()
    return shards.select("indptr", "data", "tags").mapInArrow(_row_sums, f"tag {tags}, words long, distinct_words long")


def failures(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, part and failed of each document: bit k of ``failed`` is set where it fails the filter ``FILTERS[k]``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tag = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        (100 * capitals.cast("long") > 10 * F.length(text).cast("long")).alias("c"), text.rlike("[#$%&*|]").alias("d"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    shards, _ = document_terms(docs, tag, most)
    rows = stored(row_sums(shards).select("tag.*", "words", "distinct_words"), "row-sums")
    alike = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_alike")).filter("n_alike > 1")
    known = lookup(rows, stored(alike, "alike"), "digest", "n_alike")
    fails = [F.col("words") < 100, 100 * F.col("distinct_words") < 80 * F.col("words"), F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))]
    return known.select("doc_id", "part", sum(f.cast("int") * (1 << k) for k, f in enumerate(fails)).alias("failed"))


def audit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """
    Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``shapley`` is what the step's filter removes, summed over all orders: a document that fails j filters is removed by each
    of them in 120 / j orders.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    # Rows of one id are few after this, however many there were.
    counted = failures(docs, most).groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    zero = F.lit(0)
    sets = counted.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", zero)).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", zero)).alias("toxic")
    )
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    steps = [
        {"filter_order": "".join(FILTERS[j] for j in order), "step": i + 1, "bit": 1 << k, "earlier": sum(1 << j for j in order[:i])}
        for order in permutations(range(len(FILTERS))) for i, k in enumerate(order)
    ]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, earlier: int>>")
    each = parts.select("part", "sets", F.explode(every).alias("at")).select("part", "sets", "at.*")
    bit, earlier = F.col("bit"), F.col("earlier")

    def total(where, what=lambda s: s["n"]):
        return F.aggregate(F.filter("sets", where), F.lit(0).cast("long"), lambda acc, s: acc + what(s))

    def removed(s):
        return (s["failed"].bitwiseAND(bit) != 0) & (s["failed"].bitwiseAND(earlier) == 0)

    return each.select(
        "part", "filter_order", "step",
        total(lambda s: s["failed"].bitwiseAND(bit + earlier) == 0).alias("kept"), total(removed).alias("removed"),
        total(lambda s: (s["failed"].bitwiseAND(bit) != 0) & (s["failed"].bitwiseAND(earlier) != 0)).alias("redundant"),
        total(lambda s: s["failed"] == bit).alias("unique_fails"),
        total(removed, lambda s: s["good"]).alias("good_lost"), total(removed, lambda s: s["toxic"]).alias("toxic_lost"),
        total(lambda s: s["failed"].bitwiseAND(bit) != 0, lambda s: s["n"] * (F.lit(120) / F.bit_count(s["failed"])).cast("long")).alias("shapley"),
    )
