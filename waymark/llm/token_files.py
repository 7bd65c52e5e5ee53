"""
Token files whose ids can be read one by one: directly addressable codes.

An id is cut into bytes, the low one first. Level 0 holds the low byte of every id and a bitmap that tells which
ids go on; level 1 holds the next byte of those alone, and so on. The place of an id on the next level is the
rank of its bit, read from a directory of sums every 512 bits and at most 64 bytes of the bitmap. So any token
takes a few small reads, and no block is decoded.

    magic, then little-endian 64-bit numbers: documents, tokens, levels, entries of each level
    document ids, one byte each that is 1 for a null id, first token of each document and the end
    per level: bytes; and, but for the last level, the bitmap (low bit first, padded to 64 bytes) and its directory

Documents lie in ascending order of their ids over all files. Partitions are ranges of ids, as many as the bytes of the
texts ask for. Each task encodes its range and writes files of at most ``file_tokens`` tokens and one document more;
files have unique names and only those that a finished task has listed are read.

Null texts are empty: the end id alone. Null ids come last. Rows that repeat an id are documents each, ordered by the
hash of the text; rows alike in both are dealt over the tasks of their range by their number in the scan. Extra
columns are not read. An empty table gives no file and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored, texts
from waymark.llm.tokens import byte_encoder
from waymark.session import fresh_path

FILE = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"DACTOKEN"
RANKED = 512
GROUP = 1024


def to_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(bytes, which of them go on) of each level; the last level, on which none does, has no bitmap."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        above = rest >> 8
        more = above > 0
        if not more.any():
            return [*out, (rest.astype(np.uint8), None)]
        out.append(((rest & 255).astype(np.uint8), more))
        rest = above[more]


def from_levels(levels: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
    ids = np.zeros(0, np.uint32)
    for low, more in reversed(levels):
        above, ids = ids, low.astype(np.uint32)
        if more is not None:
            ids[more] |= above << np.uint32(8)
    return ids


def _padded(n: int) -> int:
    return -(-n // RANKED) * RANKED


def serialise(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = to_levels(ids)
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels), *(len(low) for low, _ in levels)], "<u8").tobytes()]
    parts.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    parts.append(bytes(d is None for d in doc_ids))
    parts.append(np.cumsum([0, *lengths], dtype=np.uint64).astype("<u8").tobytes())
    for low, more in levels:
        parts.append(low.tobytes())
        if more is not None:
            bits = np.zeros(_padded(len(more)), bool)
            bits[: len(more)] = more
            sums = bits.reshape(-1, RANKED).sum(axis=1, dtype=np.uint32)
            parts += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(sums, dtype=np.uint32) - sums).astype("<u4").tobytes()]
    return b"".join(parts)


class TokenFile:
    """An open file: ``token(i)`` reads a few bytes, ``documents()`` and ``ids()`` whole sections."""

    def __init__(self, source):
        self.source = source
        head = self._read(0, 32)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels = (int(x) for x in np.frombuffer(head, "<u8", 3, 8))
        sizes = [int(x) for x in np.frombuffer(self._read(32, 8 * n_levels), "<u8")]
        self.docs_at = 32 + 8 * n_levels
        at, self.levels = self.docs_at + 9 * self.n_docs + 8 * (self.n_docs + 1), []
        for k, n in enumerate(sizes):
            bits_at = at + n
            rank_at = bits_at + _padded(n) // 8
            self.levels.append((n, at, bits_at, rank_at, k + 1 < n_levels))
            at = rank_at + 4 * (_padded(n) // RANKED)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (_, low_at, bits_at, rank_at, more) in enumerate(self.levels):
            value |= self._read(low_at + i, 1)[0] << 8 * k
            if not more:
                break
            block, inside = divmod(i, RANKED)
            word = int.from_bytes(self._read(bits_at + block * RANKED // 8, inside // 8 + 1), "little")
            if not word >> inside & 1:
                break
            i = int.from_bytes(self._read(rank_at + 4 * block, 4), "little") + (word & ((1 << inside) - 1)).bit_count()
        return value

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids, and their first tokens with the end of the last."""
        n = self.n_docs
        data = self._read(self.docs_at, 9 * n + 8 * (n + 1))
        ids = [None if none else i for i, none in zip(np.frombuffer(data, "<i8", n).tolist(), data[8 * n : 9 * n])]
        return ids, np.frombuffer(data, "<u8", n + 1, 9 * n).astype(np.int64)

    def ids(self) -> np.ndarray:
        levels = []
        for n, low_at, bits_at, _, more in self.levels:
            low = np.frombuffer(self._read(low_at, n), np.uint8)
            bits = np.unpackbits(np.frombuffer(self._read(bits_at, _padded(n) // 8), np.uint8), count=n, bitorder="little").astype(bool) if more else None
            levels.append((low, bits))
        return from_levels(levels)


def _writer(batches, folder, file, end, file_tokens):
    system, base = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    encoder, tail = byte_encoder(file), np.array([end], "<u4").tobytes()
    part, docs, lengths, held, tokens, seq = TaskContext.get().partitionId(), [], [], [], 0, 0

    def flush():
        path = f"{base}/{uuid.uuid4().hex}.dac"
        with system.open_output_stream(path, compression=None) as out:
            out.write(serialise(docs, lengths, np.frombuffer(b"".join(held), "<u4")))
        return pa.RecordBatch.from_pylist([dict(part=part, seq=seq, path=path, n_docs=len(docs), n_tokens=tokens)], INDEX)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = encoder.ids(text) + tail
            docs.append(doc)
            lengths.append(len(ids) // 4)
            held.append(ids)
            tokens += len(ids) // 4
            if tokens >= file_tokens:
                yield flush()
                docs, lengths, held, tokens, seq = [], [], [], 0, seq + 1
    if docs:
        yield flush()


INDEX = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write(docs: DataFrame, folder: str, file: str = FILE, end: int = END_ID, part_bytes: int = 64 << 20, file_tokens: int = 4 << 20) -> DataFrame:
    """Writes the documents into ``folder``; path, n_docs, n_tokens and base (tokens of all files before it) of each file."""
    rows = texts(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), "_hash", "_row"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    listed = stored(ordered.mapInArrow(partial(_writer, folder=folder, file=file, end=end, file_tokens=file_tokens), "part int, seq int, path string, n_docs long, n_tokens long"), "token-files")
    # Sums over the tasks before: within groups of 1,024 tasks, and over the groups.
    sums = listed.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP))
    groups = sums.groupBy("group").agg(F.sum("n").alias("n"))

    def before(window):
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = groups.select("group", before(Window.partitionBy(F.lit(0)).orderBy("group")).alias("top"))
    bases = sums.select("part", "group", before(Window.partitionBy("group").orderBy("part")).alias("low")).join(tops, "group")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(
        listed.withColumn("inner", inner).join(bases, "part").select("path", "n_docs", "n_tokens", (F.col("top") + F.col("low") + F.col("inner")).alias("base")), "token-index"
    )


def _documents(batches, folder, with_ids):
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            with system.open_input_file(path) as source:
                opened = TokenFile(source)
                docs, starts = opened.documents()
                ids = memoryview(opened.ids().astype("<u4").tobytes())
            cut = [ids[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            columns = [pa.array(docs, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64) for c in cut], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def _over_tasks(files: DataFrame) -> DataFrame:
    """One file a task, up to ten thousand tasks at once."""
    return files.repartition(max(1, min(files.count(), 10_000)))


def read(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of each document, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return _over_tasks(files.select("path", "base")).mapInArrow(partial(_documents, folder=folder, with_ids=with_ids), schema)


def _tokens(batches, folder):
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    path, opened, source = None, None, None
    for batch in batches:
        found = []
        for one, base, position in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "position"))):
            if one != path:
                if source is not None:
                    source.close()
                path, source = one, system.open_input_file(one)
                opened = TokenFile(source)
            found.append(opened.token(position - base))
        yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(found, pa.int64())], ["position", "token"])
    if source is not None:
        source.close()


def tokens_at(files: DataFrame, positions: DataFrame, folder: str, stretch: int = 1 << 20) -> DataFrame:
    """
    position and token of each distinct ``position`` (places in the whole of the files); places outside give no row.

    Each file is listed under the stretches of places it covers, so that positions meet it in an equality join.
    """
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("stretch", F.floor(F.col("position") / stretch))
    covered = files.filter("n_tokens > 0").select(
        "path", "base", "n_tokens", F.explode(F.sequence(F.floor(F.col("base") / stretch), F.floor((F.col("base") + F.col("n_tokens") - 1) / stretch))).alias("stretch")
    )
    met = wanted.join(covered, "stretch").filter((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n_tokens")))
    dealt = met.select("path", "base", "position").repartition("path", F.floor(F.col("position") / 65_536)).sortWithinPartitions("path", "position")
    return dealt.mapInArrow(partial(_tokens, folder=folder), "position long, token long")


def round_trip(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Writes every document and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, **settings), folder)
