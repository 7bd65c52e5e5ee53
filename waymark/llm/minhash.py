"""
Near copies by exact Jaccard similarity of word shingles, candidates by MinHash.

A text's set of shingle hashes gives ``BANDS`` keys of ``ROWS`` minima each; two sets that agree in half their shingles
or more often share one, two at similarity 0.8 miss all with probability (1 - 0.8 ** 7) ** 32 < 0.0006. Sets that share a
key form a coarse component, whose members then meet with their whole sets: a link is kept only if the exact similarity
reaches the bound, and every pair inside a coarse component is decided, whether it shared a key or not.

Equal sets are one node (a 64-bit hash of the set). A large coarse component is cut into cells of bounded size, every two of which
meet. Texts of fewer words than a shingle are one shingle, texts without words are one node.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import lookup, stored
from waymark.llm.simhash import WORD, components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 7
CELL_NODES, CELL_SHINGLES = 4096, 2_000_000
_random = np.random.default_rng(42)
MIX = _random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
FACTOR = _random.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    tokens = WORD.findall(text.lower())
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = (sizes + 1).cumsum() - sizes - 1
    n = max(1, len(tokens) - words + 1)
    ends = (starts + sizes)[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends.tolist())], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """One key per band, the band's number mixed in; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for begin in range(0, len(found), 512):
        least = np.minimum(least, ((found[begin : begin + 512, None] ^ MIX) * FACTOR).min(axis=0))
    digest = xxhash.xxh64_intdigest
    keys = [digest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0], np.uint64).view(np.int64)[0])


def _sketches(batches, words):
    for batch in batches:
        sets = [shingles(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *columns], ["doc_id", "hash", "node", "size", "bands"])


def _sets(batches, words):
    for batch in batches:
        sets = [shingles(t, words).astype("<u8").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("root", "cells", "node")] + [pa.array(sets, pa.binary())], ["root", "cells", "node", "shingles"])


def spanning(sets: list[np.ndarray], similarity: float):
    """A spanning forest, as pairs of places, of the links among sets."""
    size = np.array([len(s) for s in sets], np.int64)
    rest = np.argsort(size, kind="stable")
    queue, index, indexed = [], None, 0
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        if index is None or 2 * len(rest) < indexed:
            indexed = len(rest)
            flat = np.concatenate([sets[i] for i in rest]) if indexed else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            index = flat[order], np.repeat(rest, size[rest])[order]
        a = queue.pop()
        low, high = (np.searchsorted(index[0], sets[a], side) for side in ("left", "right"))
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - (n.cumsum() - n), n)
        common = np.bincount(index[1][at], minlength=len(sets))[rest]
        near = common >= similarity * (size[a] + size[rest] - common) - 1e-9
        for b in rest[near]:
            yield int(a), int(b)
        queue.extend(rest[near])
        rest = rest[~near]


def _links(batches, similarity):
    """Links within each stretch of rows of one key."""
    key, nodes, sets = None, [], []

    def judged():
        pairs = [(nodes[a], nodes[b]) for a, b in spanning(sets, similarity)]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for k, node, found in zip(*(batch.column(n) for n in ("key", "node", "shingles"))):
            if (k := k.as_py()) != key:
                if key is not None:
                    yield judged()
                key, nodes, sets = k, [], []
            nodes.append(node.as_py())
            sets.append(np.frombuffer(found.as_py(), "<u8"))
    if key is not None:
        yield judged()


def links(rows: DataFrame, firsts: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: nodes of at least the given similarity, enough of them to connect all that are linked."""
    entries = firsts.select("node", F.explode("bands").alias("key"))
    buckets = stored(entries.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    pairs = lookup(entries, buckets, "key", "n").filter("least <> node").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    coarse = components(stored(pairs, "candidates"))
    coarse = stored(coarse.unionByName(coarse.select(F.col("root").alias("node"), "root")).distinct(), "coarse")
    members = stored(coarse.join(firsts.select("node", "size", F.col("first.hash").alias("hash")), "node"), "members")
    wanted = F.ceil(F.greatest(F.count("*") / CELL_NODES, F.sum("size") / CELL_SHINGLES)).cast("long")
    sizes = stored(members.groupBy("root").agg(wanted.alias("cells"), F.count("*").alias("n")), "sizes")
    members = lookup(members.select("node", "hash", "root"), sizes, "root", "n").select("node", "hash", "root", "cells")
    texts = rows.groupBy("hash").agg(F.first("text").alias("text"))
    sets = texts.join(members, "hash").select("root", "cells", "node", "text").mapInArrow(
        partial(_sets, words=words), "root long, cells long, node long, shingles binary"
    )
    own = F.pmod(F.xxhash64("node"), F.col("cells"))
    met = sets.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    keyed = met.select(F.xxhash64("root", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "node", "shingles")
    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(partial(_links, similarity=similarity), "a long, b long")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def survivors(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and text hash of one row per component: its smallest id (null last), then its smallest hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = rows.mapInArrow(partial(_sketches, words=words), "doc_id long, hash long, node long, size long, bands array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    firsts = stored(stored(sketches, "sketches").groupBy("node").agg(first, F.max("size").alias("size"), F.first("bands").alias("bands")), "firsts")
    roots = components(stored(links(rows, firsts, words, similarity), "links"))
    linked = firsts.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return linked.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash")
