"""Archives written and read back; the query is compared with SQL too."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import warc
from barloom.llm.common import shared_path, stored


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d") for r in rows], "page_id long, url string, html string, record string, chunk int, digest string")


ROWS = [
    (1, "http://a/ b\nc", "é" * 150_001), (2, None, "é" * 150_001), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (2, "z", "y" * 200), (2, "z", "y" * 200), (None, "n", "y" * 200),
    (9, "w", "\r\nWARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 30), (10, "v", "z" * 99), (11, "v", "z" * 99), (12, "v", "z" * 100), (13, "v", "z" * 100),
]


@pytest.mark.parametrize("chunk", [1000, 1 << 16])
def test_payloads_come_back_whole(spark, chunk):
    table = stored(warc.chunk_table(pages(spark, ROWS), chunk), "chunks")
    assert table.agg(F.max(F.length("data"))).first()[0] <= chunk
    archives = warc.write_archives(table, warc.revisits(table.filter("last").select("record", "page_id", "size", "digest")), shared_path(spark, "w"), archive=100_000)
    read = warc.read_archives(archives, chunk=chunk).collect()
    by = {}
    for r in sorted(read, key=lambda r: (r["record"], r["chunk"])):
        by.setdefault(r["record"], []).append(r)
    assert len(by) == len(ROWS) and all([r["chunk"] for r in own] == list(range(len(own))) and own[-1]["last"] for own in by.values())
    got = sorted(((own[-1]["page_id"] or 0), own[-1]["record_type"], own[-1]["refers_to"], own[-1]["size"], own[-1]["digest"]) for own in by.values())
    want = []
    seen = {}
    for p, _, html in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        first = seen.setdefault(body, p) if len(body) >= 100 else p
        again = len(body) >= 100 and body in [x for x, _ in want_bodies(want)]
        want.append((p or 0, "revisit" if again else "response", first if again else None, len(body), hashlib.sha256(body).hexdigest(), body))
    assert got == sorted(w[:5] for w in want)
    bodies = sorted(b"".join(r["data"] for r in own) for own in by.values() if own[0]["record_type"] == "response")
    assert bodies == sorted(w[5] for w in want if w[1] == "response")
    assert {r["url"] for r in read if r["page_id"] == 1} == {"http://a/%20b%0Ac"}


def want_bodies(want):
    return [(w[5], w[0]) for w in want]


def test_archives_are_gzip_members_of_whole_records(spark):
    archives = warc.archived(pages(spark, ROWS[2:6]), shared_path(spark, "w"))
    total = 0
    for r in archives.collect():
        raw = open(r["file"].removeprefix("file:"), "rb").read()
        assert len(raw) == r["n_bytes"]
        text = gzip.decompress(raw).decode()
        total += text.count("WARC-Type: response")
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo") and text.endswith("\r\n\r\n")
    assert total == 4 == archives.agg(F.sum("n_records")).first()[0]
    top = archives.first()["file"].rsplit("/", 1)[0]
    assert warc.read_archives(warc.archives_in(spark, top), with_data=False).filter("last").count() == 4


def test_empty_table(spark):
    archives = warc.archived(pages(spark, ROWS[:1]).limit(0), shared_path(spark, "w"))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


def record(payload, told=None):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    digest = told or hashlib.sha256(payload).hexdigest()
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7:1>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n" % (digest.encode(), len(http) + len(payload)) + http + payload + b"\r\n\r\n"


def test_reader_tells_damage():
    rng = random.Random(1)
    payload = rng.randbytes(10_000)
    rows = list(warc.read_stream(io.BytesIO(record(payload) + record(b"")), 999))
    assert b"".join(d for r, d in rows[:-1]) == payload and rows[-1][0]["size"] == 0 and rows[-1][0]["last"]
    with pytest.raises(ValueError, match="doesn't fit"):
        list(warc.read_stream(io.BytesIO(record(payload, "0" * 64))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_stream(io.BytesIO(record(payload)[:5000])))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.read_stream(io.BytesIO(b"something else\n")))


def test_large_payloads_pass_in_chunks():
    class Zeros(io.RawIOBase):
        left, most = 200_000_000, 0

        def read(self, n=-1):
            n = min(n, self.left)
            self.left -= n
            Zeros.most = max(Zeros.most, n)
            return bytes(n)

    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:1>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    digest = hashlib.sha256()
    for _ in range(200):
        digest.update(bytes(1_000_000))
    start = io.BytesIO(head % (digest.hexdigest().encode(), 200_000_000 + 19))

    class Both:
        body = Zeros()

        def readline(self):
            return start.readline()

        def read(self, n):
            return start.read(n) or self.body.read(n)

    last = None
    for row, data in warc.read_stream(Both()):
        assert len(data) <= warc.CHUNK
        last = row
    assert last["size"] == 200_000_000 and last["last"] and Zeros.most <= warc.CHUNK
