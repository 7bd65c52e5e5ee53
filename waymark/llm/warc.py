"""
Dictionary-compressed WARC archives.

Each task writes archives of its own: a Zstandard dictionary is built from the first records (``sample_bytes`` of them),
put into a leading skippable frame, and every record is compressed on its own with it. Reading takes the dictionary
from that frame and walks record by record. Archives have unique names and only those that a finished task has
listed are read, so a repeated task does no harm.

A null payload is empty. Repeated rows of the response's id are responses too; a null id refers to the smallest id, and is
a response where no id is known. Empty tables give no archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import lookup, stored
from waymark.session import fresh_path

MAGIC = 0x184D2A5D
LEAST = 100
READ = 1 << 20
READERS = 10_000


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to: what is written for each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n_alike"))
    joined = lookup(rows, stored(groups.filter("n_alike > 1"), "alike"), "digest", "n_alike")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; too few records to train on serve as the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _writer(batches, folder, size, sample_bytes, archive_bytes, level):
    system, base = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    waiting, held, out, state = [], 0, None, {}

    def begin():
        path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        stream = system.open_output_stream(path, compression=None)
        trained = dictionary(waiting, size)
        data = trained.as_bytes()
        stream.write(MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        state.update(path=path, n=0, bytes=8 + len(data), coder=zstandard.ZstdCompressor(level=level, dict_data=trained))
        return stream

    def put(stream, data):
        frame = state["coder"].compress(data)
        stream.write(frame)
        state["n"] += 1
        state["bytes"] += len(frame)

    def done():
        return pa.RecordBatch.from_arrays([pa.array([state[k]]) for k in ("path", "n", "bytes")], ["path", "records", "bytes"])

    names = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            data = record(*row)
            if out is None:
                waiting.append(data)
                held += len(data)
                if held < sample_bytes:
                    continue
                out = begin()
                for each in waiting:
                    put(out, each)
                waiting, held = [], 0
            else:
                put(out, data)
            if state["bytes"] >= archive_bytes:
                out.close()
                out = None
                yield done()
    if waiting:
        out = begin()
        for each in waiting:
            put(out, each)
    if out is not None:
        out.close()
        yield done()


def write_archives(records: DataFrame, folder: str, size: int = 32_768, sample_bytes: int = 4 << 20, archive_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes ``records`` (see ``decide``) into ``folder``; path, records and bytes of each archive."""
    write = partial(_writer, folder=folder, size=size, sample_bytes=sample_bytes, archive_bytes=archive_bytes, level=level)
    columns = records.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return stored(columns.mapInArrow(write, "path string, records long, bytes long"), "archives")


def frames(stream):
    """Records of an open archive, one at a time."""
    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != MAGIC:
        raise ValueError("no dictionary frame")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:], "little"))))
    rest = stream.read(READ)
    while rest:
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            if not rest:
                raise ValueError("archive ends inside a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else stream.read(READ)
        rest = rest or stream.read(READ)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, body[: int(fields["content-length"])]


def _page(field: str | None):
    number = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _reader(batches, folder, payloads):
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * payloads
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            with system.open_input_stream(path, compression=None) as stream:
                for data in frames(stream):
                    fields, body = parse(data)
                    full = fields["warc-type"] == "response"
                    length = len(body) if full else int(fields["x-payload-length"])
                    digest = hashlib.sha256(body).hexdigest() if full else fields["warc-payload-digest"].removeprefix("sha256:")
                    row = (_page(fields["warc-record-id"]), length, digest, fields["warc-type"], _page(fields.get("warc-refers-to")))
                    rows.append(row + ((fields.get("warc-target-uri"), body) if payloads else ()))
                    held += len(body) if payloads else 100
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the listed archives, with url and payload bytes if asked for."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    # a partition an archive: their number is given, as a table of a few paths would be merged into one task
    spread = archives.select("path").repartitionByRange(max(1, min(archives.count(), READERS)), "path")
    return spread.mapInArrow(partial(_reader, folder=folder, payloads=payloads), schema)


def archive(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Writes every page and reads the archives back: one row per page."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(decide(pages), folder, **settings), folder)
