"""
Line dedup with two Bloom filters.

Every task marks the hashes of its documents' lines in a once-seen filter, and in a twice-seen filter those whose
bits another document had set. Only positions of set bits are shuffled; filters of tasks merge by
``twice = twice | other twice | (once & other once)``, segment by segment. A line that two documents hold is always
in the twice-seen filter. Documents then send out only suspected lines, which are confirmed by their whole key:
the smallest doc_id that holds a key keeps it. The filter has ``bits_per_line`` bits a line up to ``most_bits``,
which bounds its broadcast; beyond that more lines are suspected, and the result stays exact.

Null and empty texts are one empty line. Lines repeated within one doc_id only are kept, rows repeated with their id are
one document; a null id sorts above all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import lookup, stored, texts

LEAST = 10
STRIP = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 20
PROBES = 2
ROWS = 256
NO_ID = (1 << 63) - 1


def _small(batches):
    """Batches of few rows: texts, lines and keys are Python objects many times their bytes."""
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def key_of(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _points(key: bytes, least: int) -> int:
    n = len(key)
    return n if n < least or key.isascii() else len(key.decode("utf-8"))


def keys_of(text: bytes, least: int) -> list[bytes]:
    """Distinct keys of a text that are long enough to be judged."""
    return list({k for k in map(key_of, text.split(b"\n")) if _points(k, least) >= least})


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    """PROBES positions a key, one row each; ``size`` is a power of two."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    return np.stack([((h >> np.uint64(s)) if s else h) & np.uint64(size - 1) for s in (0, 27)[:PROBES]], 1).astype(np.int64)


def _marked(batches, size, least):
    """Positions set once and twice by this task's documents, per segment of the filter."""
    once, twice = np.zeros(size, bool), np.zeros(size, bool)
    for batch in _small(batches):
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            keys = keys_of(text, least)
            if keys:
                at = _bits(keys, size).ravel()
                twice[at[once[at]]] = True
                once[at] = True
    for segment, begin in enumerate(range(0, size, SEGMENT)):
        a, b = np.flatnonzero(once[begin : begin + SEGMENT]), np.flatnonzero(twice[begin : begin + SEGMENT])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([_short(a)], pa.binary()), pa.array([_short(b)], pa.binary())], ["segment", "once", "twice"])


def _short(positions: np.ndarray) -> bytes:
    """Positions as bytes, or the bits themselves where that is shorter; the first byte says which."""
    if 4 * len(positions) < SEGMENT // 8:
        return b"p" + positions.astype("<u4").tobytes()
    bits = np.zeros(SEGMENT, bool)
    bits[positions] = True
    return b"b" + np.packbits(bits).tobytes()


def _long(data: bytes) -> np.ndarray:
    bits = np.zeros(SEGMENT, bool)
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(bool)
    bits[np.frombuffer(data, "<u4", offset=1)] = True
    return bits


def _merged(batches):
    """Segments arrive sorted, so one segment's two filters are held at a time."""
    current, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    for batch in batches:
        for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != current:
                if current is not None:
                    yield done()
                current, once, twice = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            a = _long(a)
            twice |= _long(b) | (once & a)
            once |= a
    if current is not None:
        yield done()


def twice_seen(docs: DataFrame, size: int, least: int) -> bytes:
    """The merged twice-seen filter, ``size`` bits."""
    marks = docs.select("text").mapInArrow(partial(_marked, size=size, least=least), "segment int, once binary, twice binary")
    parts = marks.repartition(F.col("segment")).sortWithinPartitions("segment").mapInArrow(_merged, "segment int, bits binary")
    whole = bytearray(size // 8)
    for row in parts.toLocalIterator():
        whole[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = row.bits
    return bytes(whole)


def _suspects(batches, bits, size, least):
    filled = np.frombuffer(bits.value, np.uint8)
    for batch in _small(batches):
        docs, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            found = keys_of(text, least)
            if found:
                at = _bits(found, size)
                hit = ((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
                kept = [found[i] for i in np.flatnonzero(hit)]
                docs += [doc] * len(kept)
                keys += kept
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary()).cast(pa.string())], ["doc_id", "line"])


def _kept(batches, least):
    names = ["doc_id", "n_lines", "n_dropped", "text"]
    for batch in _small(batches):
        out = [[] for _ in names]
        for doc, text, drop in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
            lines = text.split("\n")
            gone = {k.encode("utf-8") for k in drop or ()}
            left = [x for x in lines if key_of(x.encode("utf-8")) not in gone] if gone else lines
            for column, value in zip(out, (doc, len(lines), len(lines) - len(left), "\n".join(left))):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def repeated_lines(docs: DataFrame, least: int = LEAST, bits_per_line: int = 16, most_bits: int = 1 << 28) -> DataFrame:
    """doc_id and ``drop``, the keys its texts lose; only for documents that lose any."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = min(most_bits, max(SEGMENT, 1 << int(bits_per_line * lines).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(twice_seen(rows, size, least))
    suspects = stored(rows.mapInArrow(partial(_suspects, bits=bits, size=size, least=least), "doc_id long, line string"), "suspects")
    firsts = suspects.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n_holders"))
    firsts = stored(firsts.filter(F.col("first") < F.col("last")).drop("last"), "firsts")
    found = lookup(suspects, firsts, "line", "n_holders").filter(F.col("first") < F.col("doc_id"))
    return found.groupBy("doc_id").agg(F.collect_set("line").alias("drop"))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST, **sizes) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, of every row."""
    rows = texts(docs)
    gone = repeated_lines(rows, least, **sizes)
    joined = rows.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left")
    return joined.select("doc_id", "text", "drop").mapInArrow(partial(_kept, least=least), "doc_id long, n_lines long, n_dropped long, text string")


def _rewritten(batches, drop):
    for batch in _small(batches):
        names = [n for n in batch.schema.names if n != drop]
        columns = {n: batch.column(n) for n in names}
        texts_now, sizes = batch.column("text").to_pylist(), None
        for i, gone in enumerate(batch.column(drop).to_pylist()):
            if gone and texts_now[i] is not None:
                gone = {k.encode("utf-8") for k in gone}
                texts_now[i] = "\n".join(x for x in texts_now[i].split("\n") if key_of(x.encode("utf-8")) not in gone)
        columns["text"] = pa.array(texts_now, pa.string())
        if "n_chars" in columns:
            sizes = [None if t is None else len(t) for t in texts_now]
            columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names)


def without(docs: DataFrame, drop: str) -> DataFrame:
    """``docs`` with the lines whose keys stand in the array column ``drop`` taken out of ``text``; ``n_chars`` follows."""
    return docs.mapInArrow(partial(_rewritten, drop=drop), docs.drop(drop).schema)
