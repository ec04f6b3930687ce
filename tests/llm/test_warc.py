import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bytewake import session
from bytewake.llm import shared_files, warc
from bytewake.staging import stage_in


class Bytes:
    """What Window needs of a file."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at:self.at + n]


def brute(rows, least=0):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for page, payload in payloads:
        same = [p for p, other in payloads if other == payload and p is not None]
        first = max(same) if len([1 for _, o in payloads if o == payload]) > 1 and same and len(payload) >= least else page
        revisit = page != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def written(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return warc.write(pages, session.work_dir(spark, "warc"), stage_in(spark, "test"), **more)


ROWS = [
    (1, "http://a/é b", "<p>one</p>"), (2, None, None), (3, "x", ""), (4, "y\r\nWARC-Type: fake", "<p>one</p>"), (5, "z", "<p>é</p>" * 500),
    (6, "w", "<p>one</p>"), (7, "v", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "v", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>" * 500), (None, "t", "alone"),
]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("range_bytes", [50, 1000, 1 << 20])
def test_records_come_back_once(spark, range_bytes):
    rnd = random.Random(range_bytes)
    rows = ROWS + [(100 + i, f"http://h/{i}", rnd.choice(["same", f"own {i}", "long " * rnd.randint(1, 300)])) for i in range(60)]
    got = warc.read(written(spark, rows), range_bytes=range_bytes).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == brute(rows)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"}
    assert payloads <= {(p, (h or "").encode()) for p, _, h in rows}


def test_small_payloads_are_responses(spark):
    rows = [(1, "a", "ab"), (2, "b", "ab"), (3, "c", "abc"), (4, "d", "abc")]
    got = warc.read(written(spark, rows, min_bytes=3), with_payload=False).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3)


def test_archives_are_plain_gzip(spark):
    for row in written(spark, ROWS).collect():
        with shared_files.open_file(row["path"]) as file:
            data = file.read()
        assert len(data) == row["size"]
        text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_magic_bytes_inside_a_record_start_none():
    inner = warc.record(9, "in", b"inner" * 50, "D", None, False, "d")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # what is packed lies in the file as it is
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n" + inner + warc.MAGIC + b"\x00" * 20
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    outer = stored.compress(head + block + b"\r\n\r\n") + stored.flush()
    plain = [warc.record(i, "u", b"p" * i, "D", None, False, "d") for i in range(3)]
    data = plain[0] + outer + plain[1] + plain[2]
    starts = [0, len(plain[0]), len(plain[0]) + len(outer), len(plain[0]) + len(outer) + len(plain[1])]
    for size in (1, 13, 400, len(data)):
        got = [m.start for a in range(0, len(data), size) for m in warc.members(warc.Window(Bytes(data)), a, min(len(data), a + size))]
        assert got == starts


def test_empty_table_and_extra_columns(spark):
    pages = spark.createDataFrame(ROWS[:1], "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit(2))
    kept = warc.write(pages, session.work_dir(spark, "warc"), stage_in(spark, "test"))
    assert warc.read(kept).count() == 1
    empty = warc.write(pages.limit(0), session.work_dir(spark, "warc"), stage_in(spark, "test"))
    assert empty.count() == 0 and warc.read(empty).count() == 0


def test_header_of_any_length_is_a_header():
    url = "https://host.example/" + "a" * (2 << 20)
    payload = b"<html>x</html>"
    made = warc.record(7, url, payload, warc.base32_sha1(payload), None, False, "2024-01-01T00:00:00Z")
    found = list(warc.members(warc.Window(Bytes(made)), 0, len(made)))
    row = warc.parse(found[0])
    assert len(found) == 1 and (row["page_id"], row["url"], row["payload"]) == (7, url, payload)
