"""Operator 13: WARC archives from and to a chunked record table.

A record's payload is never one value: it is the rows (record, chunk number) of a table, at most ``CHUNK`` bytes each, and digests are
carried along from one row to the next. The writer streams sorted rows into gzip members, one a record; the reader streams members into
such rows again. Archives are WARC 1.1 with HTTP responses; a record whose payload stood in a record before is a revisit of it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_path, stored

#: Bytes of a chunk, payload bytes of one archive, bytes from which equal payloads are kept once, and salts of a payload's records.
CHUNK, ARCHIVE, LEAST, SALTS = 1 << 16, 1 << 30, 100, 16
#: Rows that a batch between Spark and Python gathers at most before they go on.
ROWS = 64
# Names of the format.
VERSION, DATE = b"WARC/1.1", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

TABLE = "record long, page_id long, url string, chunk long, last boolean, data binary, size long, digest string"
ARCHIVES = "file string, n_records long, n_bytes long"
READ = "page_id long, record long, url string, record_type string, refers_to long, chunk long, last boolean, size long, digest string"


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of pages (page_id, url, html; null html is empty) as chunks: record (a number of its own for each row), page_id, url, chunk,
    last, data, size (payload bytes as far as this chunk) and, in the last one, digest (SHA-256 of the whole payload in hex).

    Payloads are cut within Spark, so that Python sees chunks alone; the digest goes from row to row within a task.
    """
    whole = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    sized = whole.withColumn("n", F.greatest(F.ceil(F.octet_length("body") / F.lit(chunk)), F.lit(1)).cast("long"))
    cut = sized.select("record", "page_id", "url", "body", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk"))
    rows = cut.select("record", "page_id", "url", "chunk", (F.col("chunk") == F.col("n") - 1).alias("last"), F.substring("body", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))
    return with_digests(rows)


def with_digests(rows: DataFrame) -> DataFrame:
    """Chunk rows with size and digest. The rows of a record must stand one after the other in their partition, in the order of chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size = hashlib.sha256(), 0
        for batch in batches:
            sizes, digests = [], []
            for chunk, last, data in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), batch.column("data"), strict=True):
                if chunk == 0:
                    digest, size = hashlib.sha256(), 0
                digest.update(data.as_buffer())
                size += len(data.as_buffer())
                sizes.append(size)
                digests.append(digest.hexdigest() if last else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "size", "digest"])

    return rows.mapInArrow(run, TABLE)


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """heads (record, page_id, size, digest) plus first_page and first_record where a record with the same payload of at least ``least``
    bytes has a smaller page_id, or an equal one and a smaller number; null page_ids come last."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")
    groups = heads.filter(F.col("size") >= least).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    salted = groups.select(F.col("digest").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    both = heads.withColumn("salt", F.expr(f"cast(pmod(record, {SALTS}) as int)")).join(salted, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("part")) & (F.col("size") >= least), "left")
    again = F.col("first.record") != F.col("record")
    return both.select(*heads.columns, F.when(again, F.col("first.page_id")).alias("first_page"), F.when(again, F.col("first.record")).alias("first_record"))


def _name(page_id: int | None, record: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{record}>"


def _parts(name: str) -> tuple[int | None, int]:
    _, _, page_id, record = name.strip("<>").split(":")
    return None if page_id == "null" else int(page_id), int(record)


def _head(fields: list[tuple[str, Any]], length: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", length)] if v is not None]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"


class _Archive:
    """An archive that is being written: one gzip member for each record."""

    def __init__(self, top: str, name: str):
        self.files, path = fs.FileSystem.from_uri(top)
        self.files.create_dir(path, recursive=True)
        self.file, self.n_records, self.n_bytes = f"{top}/{name}", 0, 0
        self.out = self.files.open_output_stream(f"{path}/{name}", compression=None)
        self.member: Any = None
        self.write(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.file)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], 0))
        self.end()
        self.n_records = 0

    def write(self, data: Any) -> None:
        self.member = self.member or zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.member = None
        self.n_records += 1

    def start(self, row: dict[str, Any]) -> None:
        """The head of a record and of the HTTP response in it."""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
        again = row["first_record"] is not None
        url = None if row["url"] is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _name(row["page_id"], row["record"])), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
        if again:
            fields += [("WARC-Refers-To", _name(row["first_page"], row["first_record"])), ("WARC-Profile", PROFILE)]
        self.write(_head([*fields, ("Content-Type", "application/http; msgtype=response")], len(http) + (0 if again else row["size"])) + http)

    def close(self) -> tuple[str, int, int]:
        self.n_bytes = self.out.tell()
        self.out.close()
        return self.file, self.n_records, self.n_bytes


def write_archives(table: DataFrame, decided: DataFrame, top: str, archive: int = ARCHIVE) -> DataFrame:
    """Write a chunk table and what revisits() made of its heads to archives below top: file, n_records, n_bytes, as a stored table.

    Payloads are shuffled once, by record, and sorted by (record, chunk); a task holds one chunk at a time. Names of archives are new for
    each attempt of a task, and only those of attempts that ended are listed, so that a lost executor leaves nothing half done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Archive | None = None
        held, record, at, digest, n = 0, None, 0, hashlib.sha256(), 0
        done = []
        for batch in batches:
            heads = batch.drop_columns(["data"])
            for k, (row, data) in enumerate(zip(heads.to_pylist(), batch.column("data"), strict=True)):
                if row["record"] != record:
                    if now and held >= archive:
                        done.append(now.close())
                        now, held = None, 0
                    if now is None:
                        now = _Archive(top, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz")
                    now.start(row)
                    record, at, digest, n = row["record"], 0, hashlib.sha256(), 0
                if row["chunk"] != at:
                    raise ValueError(f"record {record}: chunk {row['chunk']} came where {at} was due")
                at += 1
                if row["first_record"] is not None:
                    now.end()
                    continue
                body = data.as_buffer()
                now.write(body)
                digest.update(body)
                n += len(body)
                held += len(body)
                if row["last"]:
                    if (n, digest.hexdigest()) != (row["size"], row["digest"]):
                        raise ValueError(f"record {record}: the payload isn't the one that was digested")
                    now.end()
        if now:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], ["file", "n_records", "n_bytes"])

    # the partitions of repartition() are neither split nor read locally by adaptive execution, whichever join it chooses
    chunks = table.select("record", "page_id", "url", "chunk", "last", "data").repartition("record")
    both = chunks.join(decided.select("record", "size", "digest", "first_page", "first_record"), "record").filter("first_record is null or chunk = 0")
    rows = both.withColumn("data", F.when(F.col("first_record").isNull(), F.col("data")).otherwise(F.lit(b"")))
    return stored(rows.sortWithinPartitions("record", "chunk").mapInArrow(run, ARCHIVES), "archives")


def archives_in(spark: SparkSession, top: str) -> DataFrame:
    """The archives of a folder by name, for read_archives; their content isn't read."""
    return spark.read.format("binaryFile").load(top).select(F.col("path").alias("file"))


def _fields(file: BinaryIO) -> dict[str, str]:
    """Header lines up to the empty one."""
    found = {}
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_stream(file: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, Any], bytes]]:
    """Chunk rows and their data, record by record, from an uncompressed stream. A digest that doesn't fit is an error."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:20]!r}")
        head = _fields(file)
        left = int(head["content-length"])
        if head["warc-type"] not in ("response", "revisit"):
            while left and (piece := file.read(min(left, chunk))):
                left -= len(piece)
            continue
        page_id, record = _parts(head["warc-record-id"])
        row = {"page_id": page_id, "record": record, "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": _parts(head["warc-refers-to"])[0] if "warc-refers-to" in head else None}
        status = file.readline()
        http_head = status
        while (line := file.readline()) not in (b"\r\n", b""):
            http_head += line
        left -= len(http_head) + 2
        told = head["warc-payload-digest"].removeprefix("sha256:")
        if head["warc-type"] == "revisit":
            length = int(re.search(rb"(?im)^content-length: *(\d+)", http_head)[1])
            yield row | {"chunk": 0, "last": True, "size": length, "digest": told}, b""
            continue
        digest, size, n = hashlib.sha256(), 0, 0
        while True:
            data = file.read(min(left, chunk))
            if left and not data:
                raise ValueError("the archive ends within a record")
            left -= len(data)
            digest.update(data)
            size += len(data)
            if not left and digest.hexdigest() != told:
                raise ValueError(f"record {record}: the digest doesn't fit")
            yield row | {"chunk": n, "last": not left, "size": size, "digest": None if left else told}, data
            n += 1
            if not left:
                break


def read_archives(archives: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of archives (column file), with record_type and refers_to, and data if asked for; the last row of each record has its
    size and digest. Each archive is streamed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(names, types, strict=True)])
        for batch in batches:
            for path in batch.column("file").to_pylist():
                files, inner = fs.FileSystem.from_uri(path)
                with files.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    rows: list[dict[str, Any]] = []
                    for row, data in read_stream(plain, chunk):
                        if with_data or row["last"]:
                            rows.append(row | ({"data": data} if with_data else {}))
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    names = [x.split()[0] for x in READ.split(", ")] + (["data"] if with_data else [])
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in READ.split(", ")] + ([pa.binary()] if with_data else [])
    n = max(1, archives.count())
    return archives.select("file").repartition(n).mapInArrow(run, READ + (", data binary" if with_data else ""))


def archived(pages: DataFrame, top: str) -> DataFrame:
    """Write a record for each row of pages to archives below top and give the archives as write_archives() does.

    Of rows with equal payloads of 100 bytes or more the one with the smallest page_id is a response, and the others revisit it; of rows
    with equal page_id too, the first in the table's order; a null page_id comes last. All smaller ones are responses. A null html is
    empty, a null url is left out; payloads may be of any length; an empty table gives no archive; other columns of any name are left
    alone.
    """
    table = stored(chunk_table(pages), "chunks")
    heads = table.filter("last").select("record", "page_id", "size", "digest")
    return write_archives(table, revisits(heads), top)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: what each record says."""
    archives = archived(read_table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    rows = read_archives(archives, with_data=False).filter("last")
    return rows.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
