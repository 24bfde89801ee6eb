"""Operator 10: token ids in Simple-8b word-aligned files, and their vectorised reader.

A file set is a Parquet dataset of segments. Each row is one segment:

    shard    int     number of the file's range of doc_id, ascending
    before   long    ids in earlier segments of the same shard
    n_docs, n_ids    of this segment
    payload  binary  the coded segment, little-endian:
        8 bytes magic "S8BSEG01"; five uint64: n_docs, n_ids, n_blocks, n_words, n_escapes
        int64  doc_id[n_docs]; uint8 null_id[n_docs] padded to 8 bytes; uint64 length[n_docs]
        uint64 block_start[n_blocks]   first word of each block of 128 ids
        uint64 word[n_words]           4 bits selector above 60 bits payload, first id lowest
        uint64 escape[n_escapes]       ids of 2**60 or more, whole

Selectors 0 to 13 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1 ids of equal width into the payload; selector 15 is an
escape whose payload is the place in escape[]. Every block starts with a word of its own, so blocks decode independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, shared_path, slices, texts_of
from .tokens import default_vocabulary, encoder

BLOCK = 128
PER_WORD = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = 60 // PER_WORD
ESCAPE = 15
MAGIC = b"S8BSEG01"
SEGMENTS = "shard int, before long, n_docs long, n_ids long, payload binary"


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escapes of an array of unsigned ids."""
    v = ids.astype(U64)
    n = len(v)
    n_blocks = -(-n // BLOCK)
    size = n_blocks * BLOCK
    v = np.concatenate([v, np.zeros(size + 60 - n, U64)])
    # bit lengths; float64 is exact enough only below 2**53, so the high and low halves go apart
    high = (v >> U64(32)).astype(np.float64)
    low = (v & U64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)
    left = np.tile(np.arange(BLOCK, 0, -1, dtype=np.uint8), n_blocks)
    take = np.full(size, 13, np.uint8)  # selector; 1 x 60 unless more fit
    wide, widest = {1: bits}, bits
    for k in range(2, 9):
        widest = np.maximum(widest[: len(bits) - k + 1], bits[k - 1 :])
        wide[k] = widest
    for k, (a, b) in {10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (12, 8), 30: (20, 10), 60: (30, 30)}.items():
        m = min(len(wide[a]), len(wide[b]) - a)
        wide[k] = np.maximum(wide[a][:m], wide[b][a : a + m])
    for s in range(12, -1, -1):
        k, w = int(PER_WORD[s]), int(WIDTH[s])
        take[wide[k][:size] <= w] = s
    # an id after the block's end never counts against a selector: fewer ids are taken, and padding is zero
    at = np.arange(n_blocks) * BLOCK
    end = at + BLOCK
    block = np.arange(n_blocks)
    places, owners = [], []
    while len(at):
        places.append(at)
        owners.append(block)
        step = np.minimum(PER_WORD[take[at]], left[at])
        at = at + step
        alive = at < end
        at, end, block = at[alive], end[alive], block[alive]
    if not places:
        z = np.zeros(0, U64)
        return z, z, z
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(place)
    place, owner = place[order], owner[order]
    selector = take[place]
    words = np.zeros(len(place), U64)
    for s in range(14):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        k, w = int(PER_WORD[s]), int(WIDTH[s])
        p, room = place[rows], left[place[rows]]
        total = np.full(len(rows), s << 60, U64)
        for j in range(k):
            piece = v[p + j]
            if k > 1:
                piece = np.where(j < room, piece, U64(0))
            if s < 13:
                total |= piece << U64(j * w)
        if s == 13:
            big = v[p] >= U64(1 << 60)
            total |= np.where(big, U64(0), v[p])
        words[rows] = total
    escaped = np.flatnonzero((selector == 13) & (v[place] >= U64(1 << 60)))
    words[escaped] = (U64(ESCAPE) << U64(60)) | np.arange(len(escaped), dtype=U64)
    return words, np.searchsorted(owner, np.arange(n_blocks)).astype(U64), v[place[escaped]]


def unpack_words(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids again; all words of a selector are decoded at once."""
    out = np.zeros(len(starts) * BLOCK + 60, U64)
    if not len(words):
        return out[:0]
    selector = (words >> U64(60)).astype(np.int64)
    counts = np.concatenate([PER_WORD, [0, 1]])[selector]
    running = np.cumsum(counts) - counts
    owner = np.searchsorted(starts.astype(np.int64), np.arange(len(words)), "right") - 1
    place = running - running[starts.astype(np.int64)][owner] + owner * BLOCK
    end = (owner + 1) * BLOCK
    payload = words & U64((1 << 60) - 1)
    for s in range(14):
        rows = np.flatnonzero(selector == s)
        k, w = int(PER_WORD[s]), int(WIDTH[s])
        for j in range(k if len(rows) else 0):
            to = place[rows] + j
            ok = to < end[rows]
            out[to[ok]] = (payload[rows[ok]] >> U64(j * w)) & U64((1 << w) - 1)
    rows = np.flatnonzero(selector == ESCAPE)
    out[place[rows]] = escapes[payload[rows].astype(np.int64)]
    return out[:n]


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts, escapes = pack_words(ids)
    null = bytes(d is None for d in doc_ids)
    head = np.array([len(doc_ids), len(ids), len(starts), len(words), len(escapes)], "<u8")
    return b"".join(
        [MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null + bytes(-len(null) % 8)]
        + [np.asarray(a, "<u8").tobytes() for a in (lengths, starts, words, escapes)]
    )


def decode_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment."""
    if payload[:8] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    n_docs, n_ids, n_blocks, n_words, n_escapes = (int(x) for x in np.frombuffer(payload, "<u8", 5, 8))
    at = 48
    docs = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    null = payload[at : at + n_docs]
    at += n_docs + -n_docs % 8
    parts = []
    for n in (n_docs, n_blocks, n_words, n_escapes):
        parts.append(np.frombuffer(payload, "<u8", n, at))
        at += 8 * n
    return [None if x else d for d, x in zip(docs, null, strict=True)], parts[0].astype(np.int64), unpack_words(parts[2], parts[1], parts[3], n_ids)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, segment_ids: int = 1 << 20) -> None:
    """Encode every whole text, append end_id, and write ids in ascending doc_id order to path.

    One range shuffle of the texts, then each task streams its range: segments of about segment_ids ids are all it holds.
    Null text is empty (just end_id); null doc_id comes first; rows with the same doc_id all stay, in the order of their texts'
    hashes. Texts may be of any length. Other columns are ignored; an empty table gives no segment.
    """
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, held, doc_ids, parts
            ids = np.frombuffer(b"".join(parts), "<u4")
            body = encode_segment(doc_ids, np.array([len(p) // 4 for p in parts], "<u8"), ids)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())], ["shard", "before", "n_docs", "n_ids", "payload"])
            before += len(ids)
            doc_ids, parts, held = [], [], 0
            return row

        for batch in batches:
            for s in slices(batch, max_rows=2048):
                for d, b in zip(s.column("doc_id").to_pylist(), enc.encode(s.column("text")), strict=True):
                    doc_ids.append(d)
                    parts.append(b + end)
                    held += len(b) // 4 + 1
                    if held >= segment_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    # ranges are taken from samples of the sort keys, which the driver gathers: a hash of each text, never the text
    keyed = texts_of(docs).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids themselves.

    The only thing gathered is one total for each shard, that is for each partition of the writer.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("ahead"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, lengths, ids = decode_segment(payload.as_py())
                small = ids.astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(small[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(begins + before), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    out = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows = files.select("shard", "before", "payload").mapInArrow(decode, out)
    # one row for each partition of the writer, so the broadcast side is bounded by the job's own parallelism
    return rows.join(F.broadcast(ahead), "shard").withColumn("start", F.col("start") + F.col("ahead")).drop("shard", "ahead")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text of documents to token files in the shared folder and read them back."""
    path = shared_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
