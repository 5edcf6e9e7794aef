"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

``write_archives`` turns pages into gzip-per-record archives of bounded size, ``read_archives`` reads any
archives (gzip members or plain records) back.  A record that fails a check (member, version line, headers,
length, block or payload digest) is quarantined: the reader looks for the next valid member or version line,
goes on there, and logs the byte gap.

Edge cases: a null html is the empty payload; a null or repeated page_id is carried as it is; rows that repeat
both page_id and payload are all responses; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 8 << 20
MIN_REVISIT_BYTES = 1000
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]+[ \t]*\r\n")
READ_SCHEMA = "archive string, kind string, offset long, length long, record_type string, page_id long, refers_to long, uri string, payload_bytes long, payload_digest string, reason string"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One uncompressed record; with refers_to a revisit, which keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def _page(field: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
    return int(m[1]) if m else None


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the offset after it; Damaged if any check fails."""
    if not (m := _VERSION_LINE.match(data, at)):
        raise Damaged("version line")
    fields, pos = {}, m.end()
    while True:  # line by line, so that headers may be of any length and what is no header costs one line
        end = data.find(b"\r\n", pos)
        if end < 0:
            raise Damaged("headers")
        if end == pos:
            break
        name, colon, value = data[pos:end].partition(b":")
        pos = end + 2
        if not colon:
            raise Damaged("header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise Damaged("length")
    start, stop = end + 2, end + 2 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = data[start:stop]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise Damaged("block digest")
    out = {"record_type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")), "refers_to": _page(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri")}
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not fields.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    if out["record_type"] == "revisit":
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        out["payload_bytes"] = int(m[1]) if m else None
        claimed = fields.get("warc-payload-digest", "")
    else:
        claimed = _digest(payload)
        if fields.get("warc-payload-digest", claimed) != claimed:
            raise Damaged("payload digest")
        out["payload_bytes"] = len(payload)
    out["payload_digest"] = base64.b32decode(claimed[5:]).hex() if claimed.startswith("sha1:") else None
    return out, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A member and the offset after it, fed in steps, so that it costs its own size and not the rest of the archive."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + 65536]))
            pos += 65536
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    if not z.eof:
        raise Damaged("member is cut off")
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order of offset; the two together cover every byte."""
    at, size = 0, len(data)
    while at < size:
        try:
            found, after = list(_at(data, at)), 0
            after = found[-1].pop("_after")
            for x in found:
                x.pop("_after", None)
                yield x
            at = after
        except Damaged as e:
            nxt = _next_valid(data, at + 1)
            yield {"kind": "gap", "offset": at, "length": nxt - at, "reason": str(e)}
            at = nxt


def _at(data: bytes, at: int) -> Iterator[dict]:
    if data.startswith(_MEMBER, at):
        inner, after = _inflate(data, at)
        pos, out = 0, []
        while pos < len(inner):
            x, pos = _parse(inner, pos)
            out.append(x)
        if not out:
            raise Damaged("empty member")
        for x in out:
            yield {"kind": "record", "offset": at, "length": after - at, "_after": after} | x
    else:
        x, after = _parse(data, at)
        yield {"kind": "record", "offset": at, "length": after - at, "_after": after} | x


def _next_valid(data: bytes, at: int) -> int:
    """The next offset from which a member or plain record reads without fault, else the end."""
    while True:
        starts = [p for p in (data.find(_MEMBER, at), data.find(_VERSION, at)) if p >= 0]
        if not starts:
            return len(data)
        try:
            list(_at(data, min(starts)))
            return min(starts)
        except Damaged:
            at = min(starts) + 1


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to.  Payloads are compared by SHA-1 and length; html itself moves only once, by page_id."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = base.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"), F.octet_length("html").alias("size"))
    large = keyed.where(F.col("size") >= min_bytes)
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = large.join(first, ["digest", "size"]).where("not (page_id <=> first)").select(F.col("page_id").alias("again_id"), "digest", F.col("first").alias("refers_to")).distinct()
    rows = base.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    return rows.join(again, (rows.page_id.eqNullSafe(again.again_id)) & (rows.digest == again.digest), "left").select("page_id", "url", F.encode("html", "utf-8").alias("payload"), "refers_to")


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: rows of gzip members, each archive closed once it holds ``archive_bytes``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for i, u, p, r in (x for batch in batches for b in sized(batch, 2) for x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
            m = _member(record(i, u, p, r))
            parts.append(m)
            size += len(m)
            if size >= archive_bytes:
                yield pa.RecordBatch.from_pydict({"archive": [f"part-{task:06d}-{n:06d}.warc.gz"], "content": pa.array([b"".join(parts)], pa.binary())})
                n, parts, size = n + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"archive": [f"part-{task:06d}-{n:06d}.warc.gz"], "content": pa.array([b"".join(parts)], pa.binary())})

    return marked.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record and each quarantined gap of ``archives(archive, content)``; see READ_SCHEMA."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in READ_SCHEMA.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = [x | {"archive": b.column(0)[k].as_py()} for x in salvage(b.column(1)[k].as_py() or b"")]
                yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in rows], schema)

    return archives.select("archive", "content").mapInArrow(read, READ_SCHEMA)
