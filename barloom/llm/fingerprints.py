"""Operator 5: homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs (lines). Each paragraph is hashed to a wide vector, and the fingerprint is the sum of
these vectors modulo powers of two, so order doesn't matter and paragraphs can be added or taken away later:

    4 lanes of 64 bits   uniform hashes of the whole paragraph, summed modulo 2**64: equal multisets, equal lanes
    128 lanes of 16 bits one +1 or -1 for each three-word shingle of the paragraph, in a lane by its hash, summed modulo 2**16:
                         the squared distance of two such vectors estimates how many shingles differ

As text a fingerprint is the base64 of those 288 bytes, little-endian.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix, seeds, shingles, slices, span_hashes, texts_of, utf8

EXACT, LANES, K = 4, 128, 3
_SALTS = seeds(EXACT, 21)


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact lanes (n, 4) and shingle lanes (n, 128) of each row of UTF-8 bytes."""
    n = len(offsets) - 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:][data == 10] = True
    starts = np.flatnonzero(edge[:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data))
    stops = ends - (data[ends - 1] == 10) if len(starts) else ends  # without the line feed itself
    row = np.searchsorted(offsets, starts, "right") - 1
    h = span_hashes(data, starts, stops)
    exact = np.zeros((n, EXACT), U64)
    for j in range(EXACT):
        np.add.at(exact[:, j], row, mix(h ^ _SALTS[j]))
    s, paragraph = shingles(data, np.append(starts, len(data)), K)
    cell = row[paragraph] * LANES + (s & U64(LANES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((s >> U64(32)) & U64(1)).astype(np.float64)
    lanes = np.bincount(cell, weights=sign, minlength=n * LANES).reshape(n, LANES) if len(cell) else np.zeros((n, LANES))
    return exact, lanes.astype(np.int64).astype(np.int16)


def to_text(exact: np.ndarray, lanes: np.ndarray) -> list[str]:
    raw = np.concatenate([exact.astype("<u8").view(np.uint8).reshape(len(exact), -1), lanes.astype("<i2").view(np.uint8).reshape(len(lanes), -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", EXACT), np.frombuffer(raw, "<i2", LANES, 8 * EXACT)


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text."""
    return to_text(*vectors(*utf8(pa.array([text or ""], pa.string()))))[0]


def combined(one: str, other: str, sign: int = 1) -> str:
    """Fingerprint of the union (sign 1) or the difference (-1) of two multisets of paragraphs: insertion and deletion."""
    (a, x), (b, y) = from_text(one), from_text(other)
    return to_text((a + b if sign > 0 else a - b)[None], (x + y if sign > 0 else x - y)[None])[0]


def likeness(exact_a: np.ndarray, a: np.ndarray, exact_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 for equal fingerprints, else 1 - |a - b|**2 / (|a|**2 + |b|**2), at least 0."""
    apart = (a - b).astype(np.float64)  # int16: modulo 2**16
    x, y = a.astype(np.float64), b.astype(np.float64)
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.where(whole > 0, 1.0 - (apart * apart).sum(axis=1) / np.maximum(whole, 1.0), 0.0)
    return np.where((exact_a == exact_b).all(axis=1), 1.0, np.clip(near, 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _tree(key: Column, bounds: list[int], low: int, high: int) -> Column:
    """How many of bounds (descending) are above key, plus low, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _tree(key, bounds[mid + 1 :], low + mid + 1, high)).otherwise(_tree(key, bounds[:mid], low, low + mid))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, for which the next document by descending doc_id lends its head.

    Documents are dealt to as many ranges of doc_id as there are shuffle partitions, and each range also gets the first document
    of the next one; so texts are shuffled once and the driver sees one doc_id for each range. Null text is empty, a null doc_id
    comes last, equal doc_ids stand in the order of their texts, a single document is followed by itself, an empty table gives
    no row, and further columns are ignored.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = texts_of(docs).withColumn("k", F.coalesce("doc_id", F.lit(low).cast("long")))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted({int(b) for b in found}, reverse=True)
    rows = rows.withColumn("bucket", _tree(F.col("k"), bounds, 0, len(bounds)))
    firsts = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.max("k").alias("first")).collect()}
    used = sorted(firsts)
    nexts = spark.createDataFrame([(firsts[b], used[i - 1]) for i, b in enumerate(used)], "k long, bucket int")
    heads = rows.drop("bucket").join(F.broadcast(nexts), "k").groupBy("bucket", "k").agg(F.min("text").alias("text"))
    both = rows.select("bucket", "k", "doc_id", "text", F.lit(0).alias("tail")).union(heads.select("bucket", "k", F.lit(None).cast("long"), "text", F.lit(1)))
    dealt = both.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("tail", F.desc("k"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text: str | None = None
        held_id = None
        for batch in batches:
            for s in slices(batch):
                ids, texts = s.column("doc_id").to_pylist(), s.column("text").to_pylist()
                if held_text is not None:
                    ids, texts = [held_id, *ids], [held_text, *texts]
                held_id, held_text = ids[-1], texts[-1]
                if len(texts) < 2:
                    continue
                changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
                exact, lanes = vectors(*utf8(pa.array(texts, pa.large_string())))
                exact_c, lanes_c = vectors(*utf8(pa.array(changed, pa.large_string())))
                own, lan = exact[:-1], lanes[:-1]
                cols = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed])]
                cols += [pa.array(to_text(own, lan)), pa.array(to_text(exact_c, lanes_c)), pa.array(likeness(own, lan, exact_c, lanes_c)), pa.array(likeness(own, lan, exact[1:], lanes[1:]))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.select("doc_id", "text").mapInArrow(run, OUT)


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
