"""Helpers that the text operators share: tables in the shared folder, slices of Arrow batches, word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share.

    The folder is the one in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster is an error,
    since no folder of one machine would do.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query are deleted as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that are run within leave no shuffle files; otherwise these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, codec: str = "zstd", clean: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    With clean the shuffle files of the write go when it ends.
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession) if clean else nullcontext():
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with just those other columns that are named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20, max_rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most max_rows rows and about max_bytes of text, so that memory doesn't follow the batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(salt << 32)) * U64(_BASE))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(size, b & _MASK, U64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


_EXACT = seeds(256, 1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _FOLDED[97:123]  # A-Z as a-z


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if fold else _EXACT)[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of bytes other than space and 9 to 13, within a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(offsets, s, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and their rows. A row of fewer words, but one at least, has one of all of them."""
    s, e, row = words(data, offsets)
    h = span_hashes(data, s, e, fold)
    if not len(h):
        return h, row
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    factors = seeds(k, 2) | U64(1)
    full = max(0, len(h) - k + 1)
    out = np.zeros(len(h), U64)
    for j in range(k):
        out[:full] += h[j : j + full] * factors[j]
    inside = np.zeros(len(h), bool)
    inside[:full] = row[:full] == row[k - 1 :]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for j in range(k - 1):  # one by one, for rows of fewer words
        at = short[counts[short] > j]
        if j == 0:
            out[first[at]] = counts[at].astype(U64) * U64(0xA0761D6478BD642F)
            inside[first[at]] = True
        out[first[at]] += h[first[at] + j] * factors[j]
    return mix(out[inside]), row[inside]


def distinct_per_row(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 56-bit hashes of each row (n_rows: 256 at most) one after the other, and how many each row has.

    A row of a million hashes has two alike by chance once in a hundred thousand times.
    """
    both = np.unique((h >> U64(8)) | (row.astype(U64) << U64(56)))
    return both & U64((1 << 56) - 1), np.bincount((both >> U64(56)).astype(np.int64), minlength=n_rows)
