"""WARC archives of web pages: one gzip member per record, read back as a stream.

Writing: a record per page. Of pages with equal payloads of at least `least` bytes the one with
the smallest id is written in full, the others as revisits of it without their payload. Equal
payloads are found by their SHA-256; only digests that occur twice are joined back, once per salt,
so a payload that a third of all pages share is met by many tasks.

Reading: fixed-size reads feed an incremental zlib decompressor; a record's header ends at the
first blank line, its block is as long as Content-Length says, and a member must end where its
record does. Digests of blocks and payloads are verified. A reader holds one record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardstone.llm.store import kept_rows, new_file, open_new, open_old, slices

VERSION = b"WARC/1.1"
#: A fixed date: repeated tasks must write the same bytes.
DATE = b"2024-01-01T00:00:00Z"
SALTS = 32
READ = 1 << 16
FILES = "part int, path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def record_id(page_id: int | None) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")).encode()


def header_value(text: str) -> bytes:
    """A value on one line: control characters and the percent sign are escaped."""
    return "".join(c if c >= " " and c not in "%\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text).encode("utf-8", "surrogatepass")


def plain_value(raw: bytes) -> str:
    out, at = bytearray(), 0
    while (next_at := raw.find(b"%", at)) >= 0:
        out += raw[at:next_at] + bytes([int(raw[next_at + 1 : next_at + 3], 16)])
        at = next_at + 3
    return (out + raw[at:]).decode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response, or a revisit if it refers to a page."""
    fields = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_id(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + header_value(url))
    if page_id is not None:
        fields.append(b"Page-Id: %d" % page_id)
    fields += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Payload-Length: %d" % len(payload)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = head + payload
    else:
        block = head
        fields += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to), b"Refers-To-Page: %d" % refers_to]
    fields += [b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member, from reads of a fixed size."""
    unpacker, parts, raw = zlib.decompressobj(31), [], b""
    while True:
        raw = raw or stream.read(READ)
        if not raw:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(unpacker.decompress(raw))
        raw = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> dict:
    """A verified record: fields of RECORDS."""
    end = member.find(b"\r\n\r\n")
    lines = member[:end].split(b"\r\n")
    if end < 0 or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    block = memoryview(member)[end + 4 : end + 4 + int(fields[b"Content-Length"])]
    if len(block) != int(fields[b"Content-Length"]) or member[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    if b"sha256:" + hashlib.sha256(block).hexdigest().encode() != fields[b"WARC-Block-Digest"]:
        raise ValueError("the block does not match its digest")
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    payload = None
    if kind == "response":
        payload = bytes(block[bytes(block[:1024]).find(b"\r\n\r\n") + 4 :])
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields[b"Payload-Length"]):
            raise ValueError("the payload does not match its digest")
    url, page, other = fields.get(b"WARC-Target-URI"), fields.get(b"Page-Id"), fields.get(b"Refers-To-Page")
    return {
        "page_id": None if page is None else int(page), "url": None if url is None else plain_value(url), "record_type": kind, "payload_bytes": int(fields[b"Payload-Length"]),
        "payload_digest": digest, "refers_to": None if other is None else int(other), "payload": payload}


def write_warc(pages: DataFrame, folder: str, *, least: int = 100, parts: int | None = None) -> DataFrame:
    """Write archives of `pages` (page_id, url, html); one row per file (part, path, records,
    bytes).

    A null html is an empty payload, a null url gives no target, null ids no id. Rows that repeat
    the smallest id of their payload are all responses; a payload seen only with null ids has no
    page to refer to, so its rows are responses. An empty table writes no file."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    seen = rows.filter(F.octet_length("html") >= least).select("page_id", digest.alias("digest"))
    shared = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    salted = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    joined = rows.withColumns({"digest": digest, "salt": salt}).repartition(parts, "digest", "salt").join(salted, ["digest", "salt"], "left")
    refers = F.when((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first"))
    ready = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def work(batches):
        part, stream, path, records, size = TaskContext.get().partitionId(), None, "", 0, 0
        for batch in batches:
            for piece in slices(batch, "html"):
                if stream is None:
                    path = new_file(folder, part, ".warc.gz")
                    stream = open_new(path)
                for page_id, url, html, sha, other in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), sha, other)
                    stream.write(raw)
                    records, size = records + 1, size + len(raw)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "records": [records], "bytes": [size]})

    return kept_rows(ready.mapInArrow(work, FILES))


def read_warc(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives (column path), each read by one task in order; columns of RECORDS.
    A damaged archive raises."""

    def work(batches):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with open_old(path) as stream:
                    for member in members(stream):
                        row = parse(member)
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("path").mapInArrow(work, RECORDS)
