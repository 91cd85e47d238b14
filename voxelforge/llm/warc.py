"""WARC archives: a writer with revisit records, and a salvage reader.

The writer turns each page into one WARC/1.1 record, a gzip member of its own,
and packs records into archives of bounded size in the shared folder. Every
attempt of a task writes files of fresh names and hands back their names; only
what successful tasks hand back belongs to the archive (a manifest), so lost
executors and repeated tasks leave no doubles.

The reader streams an archive with bounded memory. Each record is checked: the
gzip member's CRC and length, the version line, the headers, the block length
and its digest. After a failed check it looks for the next place at which a
member or a version line begins that passes the checks, goes on there, and logs
the bytes between as a quarantined gap. Gaps are rows of the result, and lines
of a log beside the archive (``read_gaps``) that outlives the query.

Null html is an empty payload; null ids and urls are written as absent fields
and read back as null. Pages with equal rows each get a record. Of equal
payloads of at least ``min_revisit`` bytes the largest page_id is the response
(every row with that id, if it repeats; null ids sort below all others).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, buffers, materialize, new_path

# Fixed values of the format
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"
MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
#: A header block longer than this and than the largest block is taken for damage.
MAX_HEADER = 1 << 16
#: Suffix of the log of an archive's gaps.
GAP_LOG = ".gaps.jsonl"
ID_PREFIX = "urn:page:"


def record_id(page_id: int | None) -> str:
    return f"<{ID_PREFIX}{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One uncompressed record; a revisit has an empty block and names the response."""
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(length)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    if revisit:
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    """A record that passed its checks, and the bytes of the archive that it takes."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class _Window:
    """Random access to a growing part of a stream; what lies before ``keep`` is forgotten."""

    def __init__(self, stream):
        self.stream, self.data, self.base, self.over = stream, bytearray(), 0, False
        self.origin = stream.tell() if getattr(stream, "seekable", bool)() else None

    def need(self, end: int) -> bool:
        """Read on until the byte before ``end`` is there; False if the stream ends before."""
        while not self.over and self.base + len(self.data) < end:
            got = self.stream.read(max(CHUNK, end - self.base - len(self.data)))
            self.data += got
            self.over = not got
        return self.base + len(self.data) >= end

    def keep(self, start: int) -> None:
        if start - self.base > 4 * CHUNK:
            del self.data[: start - self.base]
            self.base = start

    def at(self, start: int, end: int) -> bytes:
        self.need(end)
        return bytes(self.data[start - self.base : max(0, end - self.base)])

    def ahead(self, start: int, end: int) -> bytes:
        """Bytes that may lie far ahead, without what is before them if the stream can seek."""
        if self.origin is None or end <= self.end or self.over:
            return self.at(start, end)
        self.stream.seek(self.origin + start)
        out = self.stream.read(end - start)
        self.stream.seek(self.origin + self.end)
        return bytes(out)

    @property
    def end(self) -> int:
        return self.base + len(self.data)


def _parse(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-cased name; None if the version line or a field is damaged."""
    if not head.startswith(VERSIONS):
        return None
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        if not line:
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        try:
            out[name.strip().decode("ascii").lower()] = value.strip().decode("utf-8")
        except UnicodeDecodeError:
            return None
    return out if out.get("content-length", "").isdigit() and "warc-type" in out else None


def _digest(field: str) -> bytes | None:
    """The SHA-1 that a digest field holds, in hex or base32 of either case; None for other algorithms and forms."""
    algorithm, _, value = field.partition(":")
    value = value.strip()
    if algorithm.strip().lower() not in ("sha1", "sha-1"):
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return bytes.fromhex(value)
    return base64.b32decode(value.upper()) if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _checked(headers: dict[str, str], block: bytes) -> bool:
    """The block agrees with its digests, as far as they can be checked.

    A block digest decides. A payload digest is of the block, or of the body
    where the block is an HTTP message; it says nothing of the block of a
    revisit or segment, nor of a body that is sent in chunks.
    """
    whole = _digest(headers.get("warc-block-digest", ""))
    if whole is not None:
        return hashlib.sha1(block).digest() == whole
    want = _digest(headers.get("warc-payload-digest", ""))
    if want is None or headers["warc-type"] not in ("response", "resource") or "warc-segment-number" in headers:
        return True
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        return not gap or b"\ntransfer-encoding:" in head.lower() or hashlib.sha1(body).digest() == want
    return hashlib.sha1(block).digest() == want


def _plain(win: _Window, at: int, limit: int) -> Record | None:
    """The uncompressed record at ``at``, if all its checks pass."""
    size = 1024
    while True:
        head = win.at(at, at + size)
        cut = head.find(b"\r\n\r\n")
        if cut >= 0 or size >= max(MAX_HEADER, limit) or len(head) < size:
            break
        size *= 4
    headers = _parse(head[: cut + 2]) if cut >= 0 else None
    if headers is None:
        return None
    begin, n = at + cut + 4, int(headers["content-length"])
    # a damaged length is found out at the record's end, before its block is read
    if n > limit or win.ahead(begin + n, begin + n + 4) != b"\r\n\r\n" or not win.need(begin + n + 4):
        return None
    rest = win.at(begin, begin + n + 4)
    if not _checked(headers, rest[:n]):
        return None
    return Record(at, begin + n + 4, headers, rest[:n])


def _member(win: _Window, at: int, limit: int) -> Record | None:
    """The gzip member at ``at`` with the record it holds, if all checks pass (zlib checks CRC and length)."""
    z, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            chunk = win.at(pos, pos + (1 << 14))
            if not chunk or len(out) > limit + MAX_HEADER:
                return None
            out += z.decompress(chunk)
            pos += len(chunk)
    except zlib.error:
        return None
    inner = _plain(_Window(io.BytesIO(bytes(out))), 0, limit)
    if inner is None or inner.end != len(out):
        return None
    return Record(at, pos - len(z.unused_data), inner.headers, inner.block)


def salvage(stream, *, max_block: int = 1 << 30) -> Iterator[Record | tuple[int, int]]:
    """Records of a WARC stream (members or plain, or a mixture) and gaps (start, end) in order.

    Memory is bounded by the largest record and a few chunks, whatever lengths
    damaged records claim (for streams that can't seek, by ``max_block`` too).
    """
    win, at, gap = _Window(stream), 0, None
    while win.need(at + 1):
        here = win.at(at, at + 10)
        found = _member(win, at, max_block) if here.startswith(GZIP_MAGIC) else _plain(win, at, max_block) if here.startswith(b"WARC/") else None
        if found is not None:
            if gap is not None:
                yield gap, at
                gap = None
            yield found
            at = found.end
            win.keep(at)
            continue
        gap = at if gap is None else gap
        at = _next_start(win, at + 1)
        win.keep(at)
    if gap is not None:
        yield gap, win.end


def _next_start(win: _Window, at: int) -> int:
    """The next byte at which a member or a version line may begin; the end of the stream if there is none."""
    while win.need(at + 1):
        win.need(at + CHUNK)
        part = win.at(at, min(win.end, at + CHUNK))
        hits = [i for i in (part.find(GZIP_MAGIC), *(part.find(v) for v in VERSIONS)) if i >= 0]
        if hits:
            return at + min(hits)
        step = len(part) - 9 if not win.over or win.end > at + len(part) else len(part)
        at += max(1, step)
        win.keep(at)
    return win.end


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def plan_revisits(pages: DataFrame, *, id_col: str, payload_col: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """All rows of ``pages`` (id, url, payload) plus digest, length, response id and whether the row is a revisit.

    Only payloads that occur twice need a partner; their ids are pre-aggregated
    by digest, so the table joined is the small side and hot payloads are split
    by adaptive execution.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    inner = pages.withColumn("digest", F.sha1(payload)).withColumn("length", F.octet_length(payload).cast("long"))
    groups = inner.where(F.col("length") >= min_revisit).groupBy(F.col("digest").alias("d")).agg(F.max(id_col).alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = inner.join(groups, F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & ~F.col("keeper").eqNullSafe(F.col(id_col))
    return joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("keeper"))).drop("d", "keeper")


def write_warc(pages: DataFrame, uri: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per row below ``uri`` and return the manifest (path, records, bytes)."""
    bounded_batches(pages.sparkSession)
    inner = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    rows = plan_revisits(inner, id_col="id", payload_col="payload", min_revisit=min_revisit)
    rows = rows.withColumn("payload", F.when(~F.col("revisit"), F.col("payload"))).select("id", "url", "payload", "digest", "length", "revisit", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(uri)
        fs.create_dir(root, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            data, off = buffers(batch.column("payload"))
            raw = data.tobytes()
            rest = [batch.column(k).to_pylist() for k in ("id", "url", "digest", "length", "refers_to", "revisit")]
            for i, (page, url, digest, length, refers, revisit) in enumerate(zip(*rest, strict=True)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = fs.open_output_stream(path, compression=None), 0, 0
                member = gzip_member(build_record(page, url, raw[off[i] : off[i + 1]], digest, length, refers, revisit, date))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0].rsplit("/", 1)[-1] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


RECORDS = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, start long, end long, is_gap boolean"


def read_warc(manifest: DataFrame, uri: str) -> DataFrame:
    """Records of the archives of a manifest, and a row with ``is_gap`` for each quarantined byte range.

    An archive is read by one task, as a stream. The payload's length and digest
    of a response are measured; a revisit has them from its headers. The gaps of
    an archive are also logged in a file beside it, the same by every attempt.
    """
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    names = manifest.select("path").repartition(n, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(uri)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, size, gaps = [], 0, []
                with fs.open_input_file(f"{root}/{name}") as stream:
                    for r in salvage(stream):
                        rows.append(_row(r, name))
                        if not isinstance(r, Record):
                            gaps.append(json.dumps({"path": name, "start": r[0], "end": r[1]}) + "\n")
                        size += len(r.block) if isinstance(r, Record) else 0
                        if size > 8 * CHUNK:
                            yield _batch(rows)
                            rows, size = [], 0
                if gaps:
                    with fs.open_output_stream(f"{root}/{name}{GAP_LOG}", compression=None) as log:
                        log.write("".join(gaps).encode())
                yield _batch(rows)

    return names.mapInArrow(run, RECORDS)


def read_gaps(spark: SparkSession, uri: str) -> DataFrame:
    """(path, start, end): the quarantined byte ranges that reading the archives below ``uri`` has logged."""
    return spark.read.schema("path string, start long, end long").option("pathGlobFilter", f"*{GAP_LOG}").json(uri)


def _row(r: Record | tuple[int, int], name: str) -> tuple:
    if not isinstance(r, Record):
        return (None, None, None, None, None, None, None, name, r[0], r[1], True)
    h = r.headers
    revisit = h["warc-type"] == "revisit"
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(r.block).hexdigest()
    length = int(h.get("x-payload-length", 0)) if revisit else len(r.block)
    text = None if revisit else r.block.decode("utf-8", "replace")
    return (page_of(h.get("warc-record-id")), h.get("warc-target-uri"), text, length, digest, h["warc-type"], page_of(h.get("warc-refers-to")), name, r.start, r.end, False)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    out = read_warc(manifest, uri).where("not is_gap")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.keeper IS NOT NULL AND g.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.keeper <> p.page_id THEN g.keeper END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
