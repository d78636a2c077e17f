"""WARC archives compressed record by record with a dictionary of their own.

A task gathers records up to ``ARCHIVE_BYTES``, trains a Zstandard dictionary on a spread
sample of their payloads, writes it compressed in a leading skippable frame and then each
record as a frame of its own. Of records with equal payloads the one with the largest
page_id is the response and the others are revisits of it.

Archives have names that no other attempt uses; only those in the returned manifest, which
Spark commits once per task, belong to the result. A task that runs again leaves at most an
unlisted file.

Defined cases: a NULL payload is an empty one, a NULL url becomes ``urn:page:<id>``. Rows
that share the largest page_id of a payload are all responses. A NULL page_id is smaller
than any other. Too few records to train on give an archive without a dictionary. Blanks
and control characters in a url are percent-encoded. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.llm.shared import slices
from trilect.operators.ordering import checked_broadcast
from trilect.session import cut, ensure_checkpoint_dir, store

ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 4 << 20, 64 << 10
#: Fixed values of the format: the skippable frame that holds a dictionary, and Zstandard's own frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda i: f"urn:page:{'none' if i is None else i}"
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else name(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{name(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        return record([*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{name(refers_to)}>")], b"")
    return record([*fields, ("Content-Type", "application/http;msgtype=response")], HTTP % len(payload) + payload)


def train(payloads: list[bytes]):
    """A dictionary from payloads spread over all, or None where they are too few."""
    import zstandard

    total = sum(map(len, payloads))
    step = max(1, -(-total // SAMPLE_BYTES))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [p for p in payloads[::step] if p])
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], payloads: list[bytes]) -> Iterator[bytes]:
    """The frames of one archive."""
    import zstandard

    trained = train(payloads)
    if trained is None:
        compressor = zstandard.ZstdCompressor(write_checksum=True)
    else:
        packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
        yield struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        compressor = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    yield compressor.compress(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)], b""))
    for r in records:
        yield compressor.compress(r)


def file_system(uri: str):
    """The file system of a folder's URI and the path in it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def read_records(stream, chunk: int = 1 << 14) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, one decompressed frame at a time."""
    import zstandard

    data = stream.read(8)
    trained = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        raw = stream.read(struct.unpack("<I", data[4:])[0])
        if struct.unpack("<I", raw[:4])[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        trained, data = zstandard.ZstdCompressionDict(raw), b""
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while data or (data := stream.read(chunk)):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes one record per page; returns the manifest (path, n_records), already committed.

    Payloads of fewer than ``least`` bytes are never made revisits.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    keyed = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    keyed = keyed.withColumn("sha", F.sha1("payload")).withColumn("n", F.length("payload"))
    # Few payloads occur twice; only those are joined, and a page without a partner stays where it is.
    copied = cut(
        keyed.filter(F.col("n") >= least)
        .groupBy("sha", "n")
        .agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    placed = keyed.join(checked_broadcast(copied), ["sha", "n"], "left").select("page_id", "url", "payload", "target")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        records, payloads, size = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with where.open_output_stream(f"{path}/{name}") as out:
                for frame in archive(records, payloads):
                    out.write(frame)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([len(records)], pa.int64())})
            records.clear()
            payloads.clear()
            return row

        where.create_dir(path, recursive=True)
        for batch in slices(batches, 2, ARCHIVE_BYTES):
            for i, u, p, target in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = target is not None and i != target
                records.append(page_record(i, u, p, target, revisit))
                if not revisit:
                    payloads.append(p)
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    size = 0
                    yield flush()
        if records:
            yield flush()

    return store(placed.mapInArrow(write, "path string, n_records bigint"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page record of the listed archives; a payload that doesn't have its digest raises."""

    def number(name: str) -> int | None:
        last = name.strip("<>").rpartition(":")[2]
        return None if last == "none" else int(last)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = file_system(uri)
                rows: list[tuple] = []
                with where.open_input_stream(path) as stream:
                    for fields, block in read_records(stream):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest, refers = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if kind == "response":
                            content = block.partition(b"\r\n\r\n")[2]
                            size = len(content)
                            if base32_sha1(content) != digest:
                                raise ValueError(f"{uri}: {fields['WARC-Record-ID']} doesn't have its digest")
                        else:
                            size, refers = int(fields["X-Payload-Length"]), number(fields["WARC-Refers-To"])
                        rows.append((number(fields["WARC-Record-ID"]), size, digest, kind, refers, fields["WARC-Target-URI"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"
    # The manifest is a few short rows; each archive is work for a task.
    parts = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count())
    return manifest.select("path").repartition(parts, "path").mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives written beside the checkpoints and read back."""
    sc = pages.sparkSession.sparkContext
    ensure_checkpoint_dir(pages.sparkSession)
    return read_archives(write_archives(pages, f"{sc.getCheckpointDir()}/warc-{uuid.uuid4().hex}", least=least))
