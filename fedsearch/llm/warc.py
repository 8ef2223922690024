"""WARC archives: write one gzip member per record, read them back (operator 6).

Writing. The first page (smallest ``page_id``) of those with an equal payload
of at least ``min_bytes`` bytes is stored as a ``response`` record, the others
as ``revisit`` records that name it; shorter payloads are always responses.
Each task writes its own files, under names no other attempt uses, and hands
their names on; only the names of finished tasks enter the manifest table, so
files of a lost or repeated attempt are never read.

Reading. A task walks an archive once from front to end: zlib inflates chunk by
chunk, a member's end is a record's end, ``Content-Length`` frames the block,
and the block and payload digests are compared with the bytes. A broken member,
a wrong length or a wrong digest raises an error that names file and offset.
One chunk and one record are in memory at a time.

Scale. Which page is first is decided on ``(page_id, digest)`` rows; pages are
shuffled once, by ``page_id``, to meet that decision (never by payload, where
one common page could hold a third of all rows). Archives are read one file
per row of a spread table; a file holds about ``file_bytes``.

Edge cases. Null html: empty payload, a response. Null url: no target header;
line breaks and other control characters in a url are percent-encoded. Null
``page_id``: its own key, never the page that others refer to. Repeated rows of
the smallest id: all responses. Empty table: no archive, empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsearch.llm.common import stored
from fedsearch.session import open_filesystem, qualified, scratch_path

MIN_BYTES = 100
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, mode: str):
    """A stream on the shared folder, whichever file system holds it; ``uri`` names that file system."""
    system, path = open_filesystem(uri)
    if mode == "w":
        system.create_dir(os.path.dirname(path), recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP header but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"),
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, _END])


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """``(offset, bytes)`` of each gzip member, inflated chunk by chunk."""
    offset, data = 0, stream.read(chunk)
    while data:
        inflater, parts, used = zlib.decompressobj(wbits=31), [], 0
        while not inflater.eof:
            if not data:
                raise ValueError(f"the member at offset {offset} ends early")
            parts.append(inflater.decompress(data))
            used += len(data) - len(inflater.unused_data)
            data = inflater.unused_data if inflater.eof else stream.read(chunk)
        yield offset, b"".join(parts)
        offset += used
        data = data or stream.read(chunk)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record, with lengths and digests verified."""
    head, mark, rest = raw.partition(_END)
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("no WARC header")
    fields = {k.lower(): v for k, v in (x.decode().split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != _END:
        raise ValueError("Content-Length does not frame the block")
    if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    http, mark, payload = block.partition(_END)
    if not mark:
        raise ValueError("no HTTP header")
    if fields["warc-type"] == "response":
        if fields["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("payload digest differs")
    return fields, http, payload


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of every record of an archive, in order."""
    with _open(uri, "r") as stream:
        for offset, raw in members(stream):
            try:
                fields, _, payload = parse(raw)
            except (ValueError, KeyError) as e:
                raise ValueError(f"{uri}, record at offset {offset}: {e}") from e
            yield fields, payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives; the manifest ``path, n_records, n_bytes``."""
    folder = qualified(pages.sparkSession, folder)  # tasks open files by this name
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = stored(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "warc-ids")
    first = ids.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = (ids.where("page_id is null or n >= " + str(min_bytes)).join(first, "digest")
                .where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("n") >= min_bytes)
                       & F.col("refers_to").isNotNull())
                .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct())
    marked = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_id"])
                       & (rows["digest"] == revisits["_digest"]), "left")
    marked = marked.select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches):
        out, path, n, size = None, None, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])],
                                              names=["path", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                packer = zlib.compressobj(LEVEL, wbits=31)
                data = packer.compress(record(page_id.as_py(), url.as_py(), body.as_py(), digest.as_py(),
                                              refers_to.as_py())) + packer.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(marked.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives named in ``paths`` (``path``).

    ``record_id, record_type, target_uri, refers_to, payload_bytes,
    payload_digest`` (of a revisit: null bytes and the digest that it claims)
    and, if asked for, ``payload``.
    """
    schema = ("record_id string, record_type string, target_uri string, refers_to string, "
              "payload_bytes long, payload_digest string" + (", payload binary" if payloads else ""))
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for f, body in records(path):
                    response = f["warc-type"] == "response"
                    rows.append([f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"),
                                 f.get("warc-refers-to"), len(body) if response else None,
                                 f["warc-payload-digest"].removeprefix("sha256:"), *([body] if payloads else [])])
                    held += len(body) * payloads + 1
                    if held >= 4 << 20 or len(rows) >= 10_000:
                        yield to_batch(rows)
                        rows, held = [], 0
        if rows:
            yield to_batch(rows)

    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = max(paths.count(), 1)  # one archive a task
    return paths.select("path").repartitionByRange(n, "path").mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them and resolve the revisits."""
    manifest = write_archives(pages, scratch_path(spark, "warc"), min_bytes)
    number = F.regexp_extract  # "<urn:page:17>" -> 17; "null" -> null
    found = stored(read_archives(manifest).select(
        F.expr("try_cast(regexp_extract(record_id, '<urn:page:(.*)>', 1) as bigint)").alias("page_id"),
        F.when(F.col("refers_to").isNotNull(), number("refers_to", r"<urn:page:(.*)>", 1).cast("bigint")).alias("refers_to"),
        "record_type", "payload_bytes", "payload_digest"), "warc-records")
    responses = (found.where("record_type = 'response'").groupBy("page_id", "payload_digest")
                 .agg(F.max("payload_bytes").alias("_bytes"))
                 .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "_bytes"))
    return found.join(responses, (found["refers_to"] == responses["_id"])
                      & (found["payload_digest"] == responses["_digest"]), "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to")
