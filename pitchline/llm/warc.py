"""WARC archives: a writer with identical-payload revisits and a splittable reader.

Each record is one gzip member.  The reader cuts files into byte ranges; a
task scans its range for the gzip magic, accepts a candidate only if it
inflates to a WARC header and ends with a valid checksum, and owns exactly the
records that start inside its range (it reads past the range's end to finish
the last one).  Files are reached through Arrow's file systems (local or
shared mounts, S3, GCS, HDFS), never through machine-local temporary folders.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import col, stored
from pitchline.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 256 << 20      # a writer task starts a new file beyond this size
RANGE_BYTES = 8 << 20          # byte range of one reader task
READ_BYTES = 1 << 18
BROADCAST_ROWS = 100_000       # repeated payload digests (about 60 bytes each) that may be broadcast

MANIFEST = "path string, bytes long, records long"
RECORDS = ("record_id string, url string, record_type string, refers_to string, payload_bytes long, "
           "payload_digest string, digest_ok boolean, path string, offset long")


def _record(rid: str, url: str | None, kind: str, refers: str | None, digest: str, size: int, payload: bytes, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\nWARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <{refers}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (record_id, url, record_type, refers_to, sha1 hex,
    payload_bytes, payload) under ``path``; the manifest (path, bytes, records)
    is written as a table.  File names are unique per task attempt, so only
    the files of attempts that succeeded are in the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": name, "bytes": size, "records": n}], schema=schema)

        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            names = ("record_id", "url", "record_type", "refers_to", "sha1", "payload_bytes", "payload")
            for rid, url, kind, refers, sha, length, payload in zip(*(batch.column(c) for c in names)):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                member = _record(rid.as_py(), url.as_py(), kind.as_py(), refers.as_py(), digest, length.as_py(), payload.as_py() or b"", date)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(records.mapInArrow(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file from a moving start, read in pieces."""

    def __init__(self, handle, at: int):
        self.f, self.at, self.buf = handle, at, b""
        self.f.seek(at)

    def more(self) -> bool:
        piece = self.f.read(READ_BYTES)
        self.buf += piece
        return bool(piece)

    def skip(self, n: int) -> None:
        self.at, self.buf = self.at + n, self.buf[n:]


def _member(w: _Window) -> tuple[bytes, int] | None:
    """The member at the window's start and its length, None if it is none."""
    z, out, fed = zlib.decompressobj(31), [], 0
    first = b""
    try:
        while not z.eof:
            if fed == len(w.buf) and not w.more():
                return None
            piece = z.decompress(w.buf[fed:])
            fed = len(w.buf)
            out.append(piece)
            if len(first) < 5:
                first = (first + piece)[:5]
                if not b"WARC/".startswith(first):
                    return None
    except zlib.error:
        return None
    return b"".join(out), fed - len(z.unused_data)


def members(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members with a WARC header that start in
    [start, end)."""
    w = _Window(handle, start)
    while w.at < end:
        while len(w.buf) < len(MAGIC) and w.more():
            pass
        i = w.buf.find(MAGIC)
        if i < 0:
            if len(w.buf) >= len(MAGIC):
                w.skip(len(w.buf) - len(MAGIC) + 1)
            if not w.more():
                return
            continue
        w.skip(i)
        if w.at >= end:
            return
        found = _member(w)
        if found is None:
            w.skip(1)
        else:
            yield w.at, found[0]
            w.skip(found[1])


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse(content: bytes) -> dict:
    """One record: ids, type and the size and SHA-1 of its full payload.  A
    revisit has them from its headers, a response from the payload itself."""
    head, rest = _headers(content)
    block = rest[: int(head["content-length"])]
    http, payload = _headers(block)
    told = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size, digest = int(http["content-length"]), told
    refers = head.get("warc-refers-to")
    return {"record_id": head["warc-record-id"].strip("<>"), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "refers_to": refers and refers.strip("<>"), "payload_bytes": size, "payload_digest": digest, "digest_ok": digest == told, "payload": payload}


def read_archives(manifest: DataFrame, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """Records of the archives named by ``manifest`` under ``path``, read by
    byte range, with the ``payload`` if asked for."""
    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).head()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fields = [("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                  ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("path", pa.string()), ("offset", pa.int64())]
        schema = pa.schema(fields + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{r['path']}") as f:
                    for at, content in members(f, r["start"], r["start"] + range_bytes):
                        rows.append(parse(content) | {"path": r["path"], "offset": at})
                        if not payloads:
                            del rows[-1]["payload"]
                        held += len(content) if payloads else 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.repartition(int(min(n, 10_000))).mapInArrow(read, RECORDS + ", payload binary" * payloads)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records for ``write_archives``: of pages with equal payloads of at least
    ``min_bytes`` bytes the one with the largest id is a response and the
    others revisit it.  A null payload is empty.  Rows with the same id and
    payload are all responses if that id is the largest; a null id is never
    the largest unless all are null.

    Digests are grouped with partial sums, so a payload that a third of all
    pages share costs one row per task; only repeated digests are joined
    back, broadcast when few (checked), else by a skew-splittable join.
    """
    p = pages.select(col(id_col).cast("long").alias("id"), col(url_col).cast("string").alias("url"),
                     F.coalesce(col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    repeated = stored(p.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(
        F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    few = repeated.count() <= BROADCAST_ROWS
    p = p.join(F.broadcast(repeated) if few else repeated, "sha1", "left")
    first = F.col("keeper").isNull() | F.col("id").eqNullSafe(F.col("keeper"))
    urn = F.lit("urn:page:")
    return p.select(F.concat(urn, F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record_id"), "url",
                    F.when(first, "response").otherwise("revisit").alias("record_type"),
                    F.when(~first, F.concat(urn, F.col("keeper").cast("string"))).alias("refers_to"),
                    "sha1", "payload_bytes", F.when(first, F.col("payload")).alias("payload"))


def op8_warc_roundtrip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    manifest = write_archives(page_records(pages), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after "urn:page:"
    return read_archives(manifest, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, octet_length(body) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS keeper,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST(concat('0x', substr(hex, CAST(i // 4 AS INTEGER) * 5 + 1, 5)) AS BIGINT) // (CAST(pow(32, 3 - i % 4) AS BIGINT))) % 32 AS INTEGER) + 1, 1)),
      'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b
"""
