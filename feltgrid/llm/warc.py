"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

The writer puts one record per page into gzip members, one member per record, and rolls files at a
bounded size. Equal payloads are stored once; later ones become revisit records. Tasks write under names
of their own attempt and return a manifest, so files of lost or repeated attempts are never read.

The reader takes any manifest of plain or compressed archives. Where a check fails (member checksum,
version line, headers, length or payload digest) it searches for the next member or version line that
holds a valid record, goes on there, and reports the bytes in between as quarantined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices
from feltgrid.operators.stage import new_path, stage

LEAST_PAYLOAD = 100
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
HEADER_BYTES = 4 << 10  # read at first; longer headers are read on to their end
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- Writing --------------------------------------------------------------------------------


def record_roles(pages: DataFrame, page_id: str, payload: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Distinct (page_id, payload_digest) with payload_bytes, record_type and refers_to.

    Digests are aggregated before the join, so a payload that a third of all pages share is one row per
    task in the aggregation, and a skewed join that Spark splits afterwards.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.select(
        F.col(page_id).alias("page_id"),
        F.sha2(body, 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    ).distinct()
    first = (
        pages.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"))
    )
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return pages.join(first, "payload_digest", "left").select(
        "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _header_text(value: object) -> str:
    return re.sub(r"[\r\n\x00]", lambda m: f"%{ord(m[0]):02X}", "" if value is None else str(value))


def record_bytes(page: object, url: object, payload: bytes, digest: str, kind: str, refers_to: object) -> bytes:
    """One plain WARC record. The page id and the full payload's length stand in extension headers."""
    block = b"" if kind == "revisit" else HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_header_text(page)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_text(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {_header_text(page)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_header_text(refers_to)}>", f"X-Refers-To-Page: {_header_text(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = LEAST_PAYLOAD,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write a record per row and return the staged manifest (path, bytes, records).

    A null payload is empty. Payloads under ``least`` bytes are never revisits. Rows equal in id and
    payload are stored alike. ``folder`` must be one that all executors share.
    """
    folder = (folder or new_path(pages.sparkSession)).rstrip("/")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256))
    roles = record_roles(pages, page_id, payload, least).withColumnRenamed("page_id", "_id").withColumnRenamed("payload_digest", "_digest")
    match = rows.page_id.eqNullSafe(roles._id) & (rows.payload_digest == roles._digest)
    rows = rows.join(roles, match).drop("_id", "_digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():05d}-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        out, path, size, n, files = None, "", 0, 0, 0
        for batch in slices(batches, "html"):
            fields = ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
            for page, link, html, digest, kind, first in zip(*(column(batch, c) for c in fields)):
                if out is None:
                    path, files = f"{name}-{files:04d}.warc.gz", files + 1
                    out, size, n = store.open_output_stream(path, compression=None), 0, 0
                data = member(record_bytes(page, link, html.encode(), digest, kind, first))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield manifest_row(path, size, n)
        if out is not None:
            out.close()
            yield manifest_row(path, size, n)

    def manifest_row(path: str, size: int, n: int) -> pa.RecordBatch:
        at = f"{folder}/{path.rsplit('/', 1)[1]}"
        return pa.RecordBatch.from_pydict({"path": [at], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return stage(rows.mapInArrow(write, "path string, bytes long, records long"))


# --- Reading --------------------------------------------------------------------------------


class Bytes:
    """Random access over bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def find(self, pattern: bytes, at: int) -> int:
        return self.data.find(pattern, at)


class File(Bytes):
    """Random access over an open file, a chunk at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.chunk = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.chunk):
            self.file.seek(at)
            self.at, self.chunk = at, self.file.read(max(n, READ_BYTES))
        return self.chunk[at - self.at : at - self.at + n]

    def find(self, pattern: bytes, at: int) -> int:
        while at < self.size:
            chunk = self.read(at, READ_BYTES)
            found = chunk.find(pattern)
            if found >= 0:
                return at + found
            at += max(1, len(chunk) - len(pattern) + 1)
        return -1


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(source: Bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and where it ends; raises Damaged if any check fails."""
    n, end = HEADER_BYTES, -1
    while end < 0:
        head = source.read(at, n)
        if not re.match(rb"WARC/1\.[01]\r\n", head):
            raise Damaged("no version line")
        end = head.find(b"\r\n\r\n")
        if end < 0 and at + n >= source.size:
            raise Damaged("no end of headers")
        n *= 4
    lines = head[:end].split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("bad header line")
        fields[key.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")) or not fields.get("warc-type"):
        raise Damaged("no length or type")
    start, length = at + end + 4, int(fields["content-length"])
    if start + length + 4 > source.size:
        raise Damaged("record is cut short")
    block = source.read(start, length + 4)
    if block[length:] != b"\r\n\r\n":
        raise Damaged("no end of record")
    payload = block[:length]
    if fields.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    wanted = fields.get("warc-payload-digest", "")
    if wanted.startswith("sha256:") and fields["warc-type"] != "revisit" and hashlib.sha256(payload).hexdigest() != wanted[7:]:
        raise Damaged("payload digest differs")
    fields["payload"] = payload
    return fields, start + length + 4


def plain_records(source: Bytes, at: int = 0) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, fields) and ('gap', start, end, reason) over plain records."""
    while at < source.size:
        try:
            fields, end = parse_record(source, at)
            yield "record", at, end, fields
            at = end
        except Damaged as error:
            start, at = at, source.find(VERSION, at + 1)
            while at >= 0 and not _valid(source, at):
                at = source.find(VERSION, at + 1)
            at = source.size if at < 0 else at
            yield "gap", start, at, str(error)


def _valid(source: Bytes, at: int) -> bool:
    try:
        return bool(parse_record(source, at))
    except Damaged:
        return False


def _inflate(source: Bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it.

    Of a damaged member, all that comes out before the damage.
    """
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        chunk = source.read(at, READ_BYTES)
        if not chunk:
            return b"".join(parts), at, "member is cut short"
        before = z.copy()
        try:
            parts.append(z.decompress(chunk))
        except zlib.error as error:
            parts += _until_damage(before, chunk)
            return b"".join(parts), at, f"member: {error}"
        at += len(chunk)
    return b"".join(parts), at - len(z.unused_data), None


def _until_damage(z: zlib._Decompress, chunk: bytes) -> Iterator[bytes]:
    """What ``chunk`` gives before its decompression fails, to the byte."""
    step = 4096
    while step:
        for at in range(0, len(chunk), step):
            before = z.copy()
            try:
                yield z.decompress(chunk[at : at + step])
            except zlib.error:
                z, chunk = before, chunk[at : at + step]
                break
        step = 1 if step > 1 else 0


def _in_member(source: Bytes, at: int) -> tuple[list[tuple[str, int, int, object]], int, str | None]:
    """Records and gaps of the member at ``at``, its end, and its damage. Of a damaged one, the records that their digest proves."""
    data, end, reason = _inflate(source, at)
    found = list(plain_records(Bytes(data)))
    if reason is not None:
        found = [x for x in found if x[0] == "record" and x[3].get("warc-payload-digest", "").startswith("sha256:") and x[3]["warc-type"] != "revisit"]
    return found, end, reason


def salvage(source: Bytes) -> Iterator[tuple[str, int, int, object]]:
    """All valid records of a plain or compressed archive, and the quarantined gaps.

    Of a damaged member, the records before the damage that pass their digest are returned; the member is
    quarantined up to the next one that gives valid records. Offsets of a record in a member are those of the member.
    """
    at = 0
    while at < source.size:
        start, reason = at, "no member or record begins here"
        if source.read(at, 3) == MEMBER:
            found, end, reason = _in_member(source, at)
            end = end if reason is None else _next_start(source, start + 1)
            for kind, _, _, what in found:
                yield kind, start, end, what
            at = end
            if reason is None:
                continue
        elif source.read(at, len(VERSION)) == VERSION and _valid(source, at):
            fields, at = parse_record(source, at)
            yield "record", start, at, fields
            continue
        else:
            at = _next_start(source, start + 1)
        yield "gap", start, at, reason


def _next_start(source: Bytes, at: int) -> int:
    """Where the next member with valid records or the next plain record begins; the end if there is none."""
    gz, plain = source.find(MEMBER, at), source.find(VERSION, at)
    while gz >= 0 or plain >= 0:
        if plain < 0 or 0 <= gz < plain:
            if any(kind == "record" for kind, *_ in _in_member(source, gz)[0]):
                return gz
            gz = source.find(MEMBER, gz + 1)
        else:
            if _valid(source, plain):
                return plain
            plain = source.find(VERSION, plain + 1)
    return source.size


ROWS = (
    "path string, kind string, start long, end long, reason string, page_id string, url string, record_type string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(manifest: DataFrame, path: str = "path", payloads: bool = True) -> DataFrame:
    """One row per record (kind 'record') and per quarantined gap (kind 'gap') of the listed archives.

    ``payload_bytes`` and ``payload_digest`` are measured on responses and are what revisits state.
    ``payload`` is null for revisits and where ``payloads`` is false. Repeated paths are read again; an
    empty manifest gives no rows.
    """

    names = [c.split()[0] for c in ROWS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in column(batch, "path"):
                store, root = fs.FileSystem.from_uri(at)
                rows, size = [], 0
                with store.open_input_file(root) as file:
                    for kind, start, end, what in salvage(File(file)):
                        rows.append(_row(at, kind, start, end, what, payloads))
                        size += end - start
                        if size > READ_BYTES or len(rows) >= 4096:
                            yield _batch(names, rows)
                            rows, size = [], 0
                yield _batch(names, rows)

    files = manifest.select(F.col(path).alias("path")).filter(F.col("path").isNotNull())
    return files.mapInArrow(read, ROWS)


def _row(path: str, kind: str, start: int, end: int, what: object, payloads: bool) -> tuple:
    if kind == "gap":
        return (path, kind, start, end, what, None, None, None, None, None, None, None)
    payload, revisit = what["payload"], what["warc-type"] == "revisit"
    stated = what.get("warc-payload-digest", "").removeprefix("sha256:") or None
    length = what.get("x-payload-length")
    return (
        path, kind, start, end, None, what.get("x-page-id"), what.get("warc-target-uri"), what["warc-type"],
        what.get("x-refers-to-page"), (int(length) if length else None) if revisit else len(payload),
        stated if revisit else hashlib.sha256(payload).hexdigest(), payload if payloads and not revisit else None,
    )


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    long, types = pa.int64(), {"payload": pa.binary()}
    columns = zip(*rows) if rows else [[] for _ in names]
    kinds = {n: long if n in ("start", "end", "payload_bytes") else types.get(n, pa.string()) for n in names}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns)], names)


def records(read: DataFrame) -> DataFrame:
    """The records among the rows of ``read_archives``, without the columns of gaps; no rows from no rows."""
    return read.filter(F.col("kind") == "record").drop("kind", "reason")


def quarantine(read: DataFrame) -> DataFrame:
    """The byte gaps that were skipped: path, start, end, reason."""
    return read.filter(F.col("kind") == "gap").select("path", "start", "end", "reason")
