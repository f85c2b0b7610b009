"""WARC records in ZIP archives, written and read by byte ranges.

Each archive is a ZIP file with two stored members: archive/data.warc.gz, of one gzip member per WARC record, and
indexes/index.cdxj, of one line per record with its offset and length in the data member. The writer marks the data
member as ZIP64. The reader never extracts: from the file's tail it reads the end record, the ZIP64 end record where there is
one, and the central directory; local headers give where members' bytes begin; the index is read as a range; and
spans of records of about SPAN bytes are dealt out evenly to as many tasks as the archives' bytes need (read_tasks()), each of which range-reads and parses its own.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one with the largest key is a response and the others
are revisits that refer to it, without their payload; smaller ones are all responses. Rows that tie on the largest key are all responses. Other columns of pages, whatever their names, are not read. Null
keys are less than all others; if all keys are null, all are responses. A null html is an empty payload. Urls may be null. Keys are of a type in KEYS and stand in their header as JSON, so
that null and empty keys differ and line breaks in a key end no header; another type raises.

Archives are written below the shared scratch folder, under names of their own for each attempt; the manifest table names
those of the attempts that Spark kept, so a lost executor or a repeated task leaves no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, scratch, table

LEAST_REVISIT = 1000
#: A task reads about TASK_BYTES of archives, or less while there are cores without work.
ARCHIVE_BYTES, SPAN, TASK_BYTES = 64 << 20, 1 << 20, 32 << 20
#: Types that keys may have.
KEYS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def record(key, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit has the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{digest}')}>"), ("WARC-Date", date), ("WARC-Page-Key", json.dumps(key)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|{digest}')}>"), ("WARC-Refers-To-Key", json.dumps(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header fields, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class ArchiveWriter:
    """One ZIP archive, written straight through to a stream."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, key, url: str | None, raw: bytes, digest: str) -> None:
        z = gzip.compress(raw, compresslevel=3, mtime=0)
        self.data.write(z)
        self.lines.append(json.dumps({"key": key, "url": url, "digest": digest, "offset": self.at, "length": len(z)}))
        self.at += len(z)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file by name: where their bytes begin and how many there are. read(offset, length) gives bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    count, directory_size, directory_at = struct.unpack("<10xHIIxx", tail[end : end + 22])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        (end64_at,) = struct.unpack("<8xQ4x", tail[end - 20 : end])
        count, directory_size, directory_at = struct.unpack("<32xQQQ", read(end64_at, 56))
    raw, found, at = read(directory_at, directory_size), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:  # ZIP64: those of the three that don't fit, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + n
        if method == 0:
            head = read(local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            name_n, extra_n = struct.unpack("<26xHH", head)
            found[name] = (local + 30 + name_n + extra_n, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def opened(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def ranges(uri: str):
    """(read, size) of a file that the shared store has."""
    f = opened(uri)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return read, f.size()


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows as records; returns the manifest (uri, records, bytes)."""
    folder = folder or scratch(pages.sparkSession, "warc")
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    latest = own.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("key").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    plan = own.join(latest, "digest", "left").withColumn("revisit", F.coalesce(F.col("target").isNotNull() & ~F.col("key").eqNullSafe(F.col("target")), F.lit(False)))
    plan = plan.select("key", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "digest", "revisit", F.when(F.col("revisit"), F.col("target")).alias("target"))

    def build(batches):
        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        writer = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                for r in batch.slice(lo, 100).to_pylist():
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.wacz"
                        sink = where.open_output_stream(f"{top}/{name}")
                        writer = ArchiveWriter(Sink(sink))
                    kind = "revisit" if r["revisit"] else "response"
                    writer.add(r["key"], r["url"], record(r["key"], r["url"], r["payload"], r["size"], r["digest"], kind, r["target"]), r["digest"])
                    if writer.at >= archive_bytes:
                        yield finish(writer, sink, name)
                        writer = None
        if writer:
            yield finish(writer, sink, name)

    def finish(writer, sink, name):
        writer.close()
        sink.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(writer.lines)], pa.int64()), pa.array([writer.at], pa.int64())], ["uri", "records", "bytes"])

    return cut(plan.mapInArrow(build, "uri string, records bigint, bytes bigint"), "manifest")


class Sink(io.RawIOBase):
    """A write-only stream without seeking, over Arrow's."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def read_tasks(total_bytes: int, cores: int) -> int:
    """Tasks that read so many bytes of archives. Spark can't tell from the spans' rows, which are small whatever they stand for."""
    return max(1, -(-total_bytes // TASK_BYTES), min(cores, -(-total_bytes // SPAN)))


def read_records(manifest: DataFrame, key_type: str = "bigint", span: int = SPAN) -> DataFrame:
    """(key, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all records of the manifest's archives. A
    revisit's payload is null, its size and digest those of its header; a response's digest is computed and held against its header."""

    def locate(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                read, size = ranges(uri)
                found = members(read, size)
                begin, _ = found[DATA]
                at, n = found[INDEX]
                lines = [json.loads(x) for x in read(at, n).split(b"\n") if x]
                spans, lengths = [], []
                for x in lines:
                    if not spans or lengths[-1] and sum(lengths[-1]) >= span:
                        spans.append(begin + x["offset"])
                        lengths.append([])
                    lengths[-1].append(x["length"])
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(spans)), pa.array(spans, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["uri", "at", "lengths"])

    if key_type not in KEYS:
        raise ValueError(f"keys of type {key_type} are not read; {', '.join(KEYS)} are")
    key_arrow = KEYS[key_type]

    def parse_span(batches):
        for batch in batches:
            for uri, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, k, rows = ranges(uri)[0](at, sum(lengths)), 0, []
                for n in lengths:
                    fields, http, payload = parse(zlib.decompress(raw[k : k + n], 31))
                    k += n
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    response = fields["WARC-Type"] == "response"
                    size = len(payload) if response else int(http.rpartition(b"Content-Length: ")[2])
                    if response and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"a payload in {uri} doesn't have its digest")
                    key, to = (json.loads(fields.get(f, "null")) for f in ("WARC-Page-Key", "WARC-Refers-To-Key"))
                    rows.append((key, fields.get("WARC-Target-URI"), fields["WARC-Type"], to, size, digest, payload if response else None))
                cols = list(zip(*rows, strict=True))
                types = [key_arrow, pa.string(), pa.string(), key_arrow, pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    total = manifest.agg(F.count("*").alias("archives"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    spans = manifest.select("uri").repartition(max(1, min(total["archives"], max(cores, total["archives"] // 8)))).mapInArrow(locate, "uri string, at bigint, lengths array<bigint>")
    return spans.repartition(read_tasks(total["bytes"], cores)).mapInArrow(parse_span, f"key {key_type}, url string, record_type string, refers_to {key_type}, payload_bytes bigint, payload_digest string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_records(manifest).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN target <> page_id THEN target END AS refers_to FROM p LEFT JOIN t USING (payload_digest)
"""
