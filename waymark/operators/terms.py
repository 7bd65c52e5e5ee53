"""
The words of many texts as numbers, without a row for each word of each text.

Tasks cut texts into shards with words of their own, kept packed: the bytes of all words, and their lengths. A shard's words
are dealt to buckets by hash, a row a bucket; a bucket gives its distinct words numbers and goes back as a row a shard.
So a word is shuffled once per shard that holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.session import checkpointed

BUCKET_WORDS = 400_000
BROADCAST_IDS = 200_000
SHARD_TOKENS = 1_000_000  # words of a shard's texts, and a text more
NAMES = ["shard", "words", "lengths", "held", "indptr", "indices", "counts", "sizes", "ids"]


def packed(words: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of all words one after the other, and their lengths."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, "<i4")[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, "<i4")
    return bytes(memoryview(data)[ends[0] : ends[-1]]) if ends[-1] > ends[0] else b"", np.diff(ends).astype("<i4").tobytes()


def word_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number of 31 bits for each word, none of them empty: its bytes as digits, modulo 2^64."""
    starts = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.full(lengths.max(initial=1), 0x100000001B3, np.uint64))
    digits = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)]
    sums = np.add.reduceat(digits, starts) if len(starts) else np.zeros(0, np.uint64)
    sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (sums >> np.uint64(33)).astype(np.int64)


def dealt_words(batches, buckets, counted=False):
    """
    The words of each shard by bucket: a row holds those of one shard in one bucket, and their places in the shard; if
    ``counted``, in how many texts of the shard each is.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            data, lengths = (np.frombuffer(batch.column(c)[at].as_py(), k) for c, k in (("words", "u1"), ("lengths", "<i4")))
            if not len(lengths):
                continue
            bucket = word_hashes(data, lengths) % buckets
            order = np.argsort(bucket, kind="stable").astype("<i4")
            words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths, dtype=np.int64)]), pa.py_buffer(data)])
            data, lengths = words.take(pa.array(order)).buffers()[2], lengths[order]
            ends, filled = np.r_[0, np.cumsum(lengths, dtype=np.int64)], np.flatnonzero(np.bincount(bucket, minlength=buckets))
            edges = np.append(np.searchsorted(bucket[order], filled), len(order))
            spans = list(zip(edges, edges[1:]))
            columns = [
                pa.array(filled, pa.int64()), pa.array([batch.column("shard")[at].as_py()] * len(filled), pa.binary()),
                pa.array([bytes(memoryview(data)[ends[a] : ends[b]]) for a, b in spans], pa.binary()),
            ]
            more = {"lengths": lengths, "places": order}
            if counted:
                more["held"] = np.frombuffer(batch.column("held")[at].as_py(), "<i4")[order]
            columns += [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in more.values()]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "words", *more])


def bucket_words(table):
    """All words of a bucket as numbers of its distinct words, those in order, and how many each row has."""
    sizes = pc.binary_length(table["lengths"]).to_numpy() // 4
    lengths = np.frombuffer(b"".join(table["lengths"].to_pylist()), "<i4")
    ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(table["words"].to_pylist()))])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order)), sizes


def _cut(batches: Iterator[pa.RecordBatch], side: int, id_type: pa.DataType, most: int) -> Iterator[pa.RecordBatch]:
    """Shards of rows (id, tokens)."""
    coder = zstandard.ZstdCompressor(level=1)
    held, size = [], 0

    def flush():
        nonlocal held, size
        tokens, sizes, ids = (list(x) for x in zip(*held))
        held, size = [], 0
        coded, sizes = pa.concat_arrays(tokens).dictionary_encode(), np.concatenate(sizes)
        n_words = len(coded.dictionary)
        entries, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(n_words, 1) + coded.indices.to_numpy(), return_counts=True)
        rows, indices = np.divmod(entries, max(n_words, 1))
        documents = np.bincount(indices, minlength=n_words) if side == 0 else np.zeros(n_words)
        numbers = [documents.astype("<i4"), np.r_[0, np.cumsum(np.bincount(rows, minlength=len(sizes)))].astype("<i8")]
        numbers = [x.tobytes() for x in numbers] + [coder.compress(x.astype("<i4").tobytes()) for x in (indices, counts, sizes)]
        ids = pa.concat_arrays(ids)
        one = [pa.array([x], pa.binary()) for x in (uuid.uuid4().bytes, *packed(coded.dictionary.cast(pa.binary())), *numbers)]
        return pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), *one, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["side", *NAMES])

    for batch in batches:
        sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            stop = min(batch.num_rows, 1 + int(np.searchsorted(ends, done + most - size)))
            part = batch.slice(begin, stop - begin)
            held.append((part.column("tokens").flatten(), sizes[begin:stop], part.column("id").cast(id_type)))
            size, begin = size + int(ends[stop - 1] - done), stop
            if size >= most:
                yield flush()
    if held:
        yield flush()


def _counted(key, table, buckets: int) -> pa.Table:
    """For each shard in the bucket the numbers of its words, and in how many texts of side 0 each is."""
    rank, words, sizes = bucket_words(table)
    held = np.frombuffer(b"".join(table["held"].to_pylist()), "<i4")
    df, ids, ends = np.bincount(rank, held, len(words))[rank], rank * buckets + key[0].as_py(), np.r_[0, np.cumsum(sizes)]
    numbers = [pa.array([x[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:])], pa.binary()) for x in (ids, df)]
    return pa.table({"shard": table["shard"], "places": table["places"], "word_ids": numbers[0], "df": numbers[1]})


def to_planes(head: np.ndarray, sizes: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """
    One binary a row: a number of its own, then its part of each column, lowest bytes of all its numbers first. Sorted or
    small numbers have higher bytes that are alike and next to each other, which the shuffle's compression takes out.
    """
    ends = np.r_[0, np.cumsum(4 + 4 * len(columns) * sizes)]
    out = np.zeros(ends[-1], np.uint8)
    out[(ends[:-1, None] + np.arange(4)).ravel()] = head.astype("<i4").view(np.uint8)
    width = np.repeat(sizes, sizes)
    at = np.repeat(ends[:-1] + 4, sizes) + np.arange(len(width)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for column in columns:
        for low in range(4):
            out[at] = (column >> (8 * low)) & 255
            at += width
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(out)])


def from_planes(load: pa.ChunkedArray | pa.Array, columns: int) -> tuple[np.ndarray, ...]:
    """The numbers of the rows, the row of each entry, and the columns."""
    flat = load.combine_chunks() if isinstance(load, pa.ChunkedArray) else load
    if not len(flat):
        return np.zeros(0, np.int32), *(np.zeros(0, np.int32) for _ in range(columns + 1))
    _, ends, data = flat.buffers()
    ends = np.frombuffer(ends, "<i4")[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    sizes = (np.diff(ends) - 4) // (4 * columns)
    head = np.ascontiguousarray(data[ends[:-1, None] + np.arange(4)]).view("<i4").ravel()
    rows, width = np.repeat(np.arange(len(flat), dtype=np.int32), sizes), np.repeat(sizes, sizes)
    at = np.repeat(ends[:-1] + 4, sizes) + np.arange(len(width)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for _ in range(columns):
        column = np.zeros(len(at), np.int32)
        for low in range(4):
            column |= data[at].astype(np.int32) << (8 * low)
            at += width
        out.append(column)
    return head, rows, *out


def _loads(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, load) of shards: words and counts of a text after its length, and for side 1 in how many texts of side 0 each word is, without those in none."""
    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(batch.num_rows):
            indptr = np.frombuffer(batch.column("indptr")[at].as_py(), "<i8")
            indices, counts, sizes = (np.frombuffer(coder.decompress(batch.column(c)[at].as_py()), "<i4") for c in ("indices", "counts", "sizes"))
            named, ids = batch.column("named")[at], batch.column("ids")[at].values
            parts = [[np.frombuffer(x, "<i4") for x in named.values.field(f).to_pylist()] for f in ("places", "word_ids", "df")] if named.is_valid else [[], [], []]
            names, df = np.zeros((2, sum(map(len, parts[0]))), np.int32)
            for places, word_ids, held in zip(*parts):
                names[places], df[places] = word_ids, held
            rows, codes, df = np.repeat(np.arange(len(sizes)), np.diff(indptr)), names[indices], df[indices]
            order = np.lexsort((codes, rows))
            order = order[df[order] > 0] if side else order
            n = np.bincount(rows[order], minlength=len(sizes))
            columns = [x[order] for x in ((codes, counts, df) if side else (codes, counts))]
            load = to_planes(sizes, n, *columns)
            some = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([ids.take(some), load.take(some)], ["id", "load"])


def packed_terms(docs: DataFrame, requests: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, float]:
    """
    Texts and requests, both (id, tokens), as (id, load) for ``from_planes``, and the mean number of tokens of the texts.
    Rows without words, and requests without a word of any text, are left out.
    """
    kinds = [df.schema["id"].dataType for df in (docs, requests)]
    shards = []
    for side, (df, kind) in enumerate(zip((docs, requests), kinds)):
        ddl = f"side int, {', '.join(f'{n} binary' for n in NAMES[:-1])}, ids array<{kind.simpleString()}>"
        cut = partial(_cut, side=side, id_type=to_arrow_type(kind), most=most or SHARD_TOKENS)
        shards.append(checkpointed(df.filter(F.col("tokens").isNotNull()).mapInArrow(cut, ddl)))
    dictionaries = shards[0].select("shard", "words", "lengths", "held").union(shards[1].select("shard", "words", "lengths", "held"))
    buckets = max(1, -(-(dictionaries.agg(F.sum(F.octet_length("lengths").cast("long"))).first()[0] or 0) // (4 * BUCKET_WORDS)))
    dealt = dictionaries.mapInArrow(
        partial(dealt_words, buckets=buckets, counted=True), "bucket long, shard binary, words binary, lengths binary, places binary, held binary"
    )

    def counted(key, table):
        return _counted(key, table, buckets)

    named = dealt.groupBy("bucket").applyInArrow(counted, "shard binary, places binary, word_ids binary, df binary")
    named = checkpointed(named.groupBy("shard").agg(F.collect_list(F.struct("places", "word_ids", "df")).alias("named")))
    loads = [
        s.select("shard", "indptr", "indices", "counts", "sizes", "ids").join(named, "shard", "left")
        .mapInArrow(partial(_loads, side=side), f"id {kind.simpleString()}, load binary")
        for side, (s, kind) in enumerate(zip(shards, kinds))
    ]
    return loads[0], loads[1], _mean_tokens(shards[0])


def once_and_again(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and the rows of ids that repeat, a null among them, if there are any."""
    repeated = checkpointed(df.groupBy(F.col(id_col).alias("_repeated")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_repeated"))
    n = repeated.count()
    if not n:
        return df, None
    if n <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    same = F.col(id_col).eqNullSafe(F.col("_repeated"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def _mean_tokens(shards: DataFrame) -> float:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total, n = zstandard.ZstdDecompressor(), 0, 0
        for batch in batches:
            for x in batch.column("sizes").to_pylist():
                sizes = np.frombuffer(coder.decompress(x), "<i4")
                total, n = total + int(sizes.sum(dtype=np.int64)), n + len(sizes)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total], pa.int64()), "n": pa.array([n], pa.int64())})

    total, n = shards.select("sizes").mapInArrow(add, "total long, n long").agg(F.sum("total"), F.sum("n")).first()
    return total / n if n else 0.0
