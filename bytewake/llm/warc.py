"""WARC archives: a writer with revisit records, and a splittable reader.

Writer.  Every page is a record and every record is a gzip member of its own.
Of pages with equal payloads of at least ``min_bytes`` bytes, those with the
largest id are responses and the others revisits, which hold the HTTP header but
no payload and name the response's record.  The largest id per digest is
summed up in each task before the shuffle and only digests with several pages
are kept, so that the join is small, and Spark splits a payload that a large
part of all pages share.

Reader.  Archives are cut into byte ranges, whatever lies in them, and each task
owns the records that start inside its ranges.  It looks for the magic bytes of
gzip, takes a place as the start of a record only if what is there inflates to a
WARC header and the member is followed by the end of the file or by another one,
and from there goes from member to member, reading past its range to end the
last.  So one archive of any size is read by many tasks.

Defined results: a null or empty page has an empty payload, and empty payloads
are equal; rows that share the largest id of a payload are all responses; a
page without an id refers to others but is only a response where none of its
payload has an id; an address is percent-encoded where it holds white space,
control or other non-ASCII characters, and null if it was null; an empty table
gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewake.llm import shared_files
from bytewake.llm.common import steps
from bytewake.staging import Stage

RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: the most reading tasks
TASKS = 20_000
#: of a member at first; then twice as many each time
FIRST_BYTES = 1 << 12
LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:bytewake:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{NAME}{_text(page_id)}>"), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{NAME}{_text(refers_to)}>")]
    fields.append(("Content-Length", str(len(block))))
    header = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(header) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _text(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def _id(name: str | None) -> int | None:
    digits = (name or "").strip("<>").removeprefix(NAME)
    return int(digits) if digits else None


def write(
    pages: DataFrame, folder: str, stage: Stage, min_bytes: int = 0, page_id: str = "page_id", url: str = "url",
    html: str = "html", date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Archives of all pages below ``folder``; returns their manifest (path, size)."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = rows.withColumn("key", F.sha1("payload"))
    equal = (
        keyed.where(F.octet_length("payload") >= min_bytes).groupBy("key")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    marked = keyed.join(equal, "key", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, size = None, None, 0
        for batch in batches:
            for part in steps(batch, "payload"):
                if file is None:
                    path = shared_files.new_file(folder, ".warc.gz")
                    file = shared_files.create(path)
                for key, at, payload, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                    revisit = first is not None and key != first
                    member = record(key, at, payload, base32_sha1(payload), first, revisit, date)
                    file.write(member)
                    size += len(member)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], names=["path", "size"])

    return stage(marked.mapInArrow(run, "path string, size long"), "archives")


@dataclass
class Member:
    start: int
    end: int
    content: bytes


class Window:
    """A file read forwards in pieces; bytes before ``keep`` are let go."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start`` on."""
        if not self.base <= start or start + n > self.base + len(self.data):
            to = min(self.size, start + max(n, READ_BYTES))
            self.file.seek(start)
            self.base, self.data = start, self.file.read(max(0, to - start))
        at = start - self.base
        return self.data[at:at + n]


def inflate(window: Window, start: int) -> Member | None:
    """The record that starts at an offset, or None if none does."""
    unpacker = zlib.decompressobj(31)
    parts, at, size, step, checked = [], start, 0, FIRST_BYTES, False
    try:
        while not unpacker.eof:
            piece = window.get(at, step)
            step = min(2 * step, READ_BYTES)
            if not piece:
                return None
            parts.append(unpacker.decompress(piece))
            at += len(piece)
            size += len(parts[-1])
            if not checked and (size >= len(VERSION) or unpacker.eof):
                checked = True
                if not b"".join(parts).startswith(VERSION[:5]):
                    return None
    except zlib.error:
        return None
    end = at - len(unpacker.unused_data)
    content = b"".join(parts)
    return Member(start, end, content) if b"\r\n\r\n" in content else None


def begins(window: Window, at: int) -> bool:
    """Whether a record or the end of the file is at an offset."""
    if at >= window.size:
        return True
    try:
        return zlib.decompressobj(31).decompress(window.get(at, FIRST_BYTES), len(VERSION)).startswith(VERSION[:5])
    except zlib.error:
        return False


def members(window: Window, start: int, end: int) -> Iterator[Member]:
    """Records that start in [start, end)."""
    at = start
    while at < end:
        n = min(READ_BYTES, end + len(MAGIC) - 1 - at)
        found = window.get(at, n).find(MAGIC)
        if found < 0:
            at += max(1, n - len(MAGIC) + 1)
            continue
        at += found
        member = inflate(window, at) if at < end else None
        if member is None or not begins(window, member.end):
            at += 1
            continue
        yield member
        at = member.end


HEADER = re.compile(rb"^([^\s:]+):[ \t]*(.*?)\r?$", re.MULTILINE)


def headers(block: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, v in HEADER.findall(block)}


def parse(member: Member) -> dict:
    head, _, rest = member.content.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = warc["warc-type"]
    stated = warc["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != stated:
        raise ValueError(f"payload of {warc['warc-record-id']} has another digest than its header")
    return {
        "page_id": _id(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "record_type": kind,
        "payload_digest": stated, "payload_bytes": int(headers(http)["content-length"]),
        "refers_to": _id(warc.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
DDL = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def read(archives: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Page records of archives (path, size); without payloads they are checked but not returned."""
    # few bytes that stand for much work: their number decides, not their size
    n = archives.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    ranges = archives.where("size > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                with shared_files.open_file(task["path"]) as file:
                    rows, held = [], 0
                    window = Window(file)
                    for member in members(window, task["start"], min(window.size, task["start"] + range_bytes)):
                        row = parse(member)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return ranges.repartition(min(int(n), TASKS), "path", "start").mapInArrow(run, DDL)
