"""Operator 3: pack token sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts_of
from .tokens import default_vocabulary, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cells(capacity: int, fine: int = 16) -> np.ndarray:
    """Longest lengths of the classes that the program works on: every length up to 2 * fine, then fine classes an octave."""
    out, low = [], 1
    while low < capacity:
        width = max(1, (1 << low.bit_length() - 1) // fine)
        out.append(min(capacity - 1, low // width * width + width - 1))
        low = out[-1] + 1
    return np.array([*out, capacity], np.int64)


def price(weight: np.ndarray, sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest configuration by dynamic programming over capacities: which classes, how often each (need at most).

    Bounded knapsack: a class enters as 1, 2, 4, ... copies and a rest.
    """
    best = np.zeros(capacity + 1)
    choices = []
    for g in np.flatnonzero(need > 0).tolist():
        size, copies, k = int(sizes[g]), min(int(need[g]), capacity // int(sizes[g])), 1
        while copies > 0:
            k = min(k, copies)
            copies -= k
            other = best[: capacity + 1 - k * size] + k * weight[g]
            better = other > best[k * size :] + 1e-12
            np.maximum(best[k * size :], other, out=best[k * size :])
            choices.append((g, k, k * size, better))
            k *= 2
    left, chosen = capacity, {}
    for g, k, size, better in reversed(choices):
        if left >= size and better[left - size]:
            chosen[g] = chosen.get(g, 0) + k
            left -= size
    keys = np.array(sorted(chosen), dtype=np.int64)
    return keys, np.array([chosen[g] for g in keys.tolist()], dtype=np.int64)


def multiplicative_weights(need: np.ndarray, sizes: np.ndarray, capacity: int, rate: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Fractional solution of: fewest configurations that cover need[g] items of every class g. All of need is above 0.

    Weights start at size / capacity, the fluid dual. Each step prices a configuration of classes that aren't covered yet, takes it
    until a share of the need of its scarcest class is met, and lowers the weights of what it covers. That ends with all covered.
    """
    weight, cover = sizes / capacity, np.zeros(len(need))
    found: dict[bytes, list] = {}
    while (cover < 1).any():
        keys, m = price(weight, sizes, np.where(cover < 1, need, 0), capacity)
        step = rate * float(np.min(need[keys] / m))
        entry = found.setdefault(keys.tobytes() + m.tobytes(), [keys, m, 0.0])
        entry[2] += step
        share = step * m / need[keys]
        cover[keys] += share
        weight[keys] *= np.exp(-share)
    return [tuple(x) for x in found.values()]


class _Pool:
    """Items that are left of each length, and the longest one there is up to some length."""

    def __init__(self, need: np.ndarray):
        self.left = need.tolist()
        self.below = [x if n or not x else x - 1 for x, n in enumerate(self.left)]

    def longest(self, most: int, used: dict[int, int]) -> int:
        """Longest length up to most of which there are more items than used; 0 if there is none."""
        while True:
            root = most
            while self.below[root] != root:
                root = self.below[root]
            while self.below[most] != root:
                self.below[most], most = root, self.below[most]
            if not root or self.left[root] > used.get(root, 0):
                return root
            most = root - 1

    def finish(self, used: dict[int, int], room: int) -> int:
        """Fill up room by best fit; what stays free."""
        while room > 0 and (x := self.longest(room, used)):
            used[x] = used.get(x, 0) + 1
            room -= x
        return room

    def take(self, used: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Take a set of items as often as there are such items, most times at most."""
        times = min(most, *(self.left[x] // n for x, n in used.items()))
        for x, n in used.items():
            self.left[x] -= n * times
            if not self.left[x]:
                self.below[x] = x - 1
        keys = sorted(used)
        return np.array(keys), np.array([used[x] for x in keys]), times


def solve(need: np.ndarray, capacity: int, rate: float = 0.5) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], int]:
    """Integral configurations that hold every item exactly once, and how many items the program's configurations hold.

    Each round solves the program over classes of lengths for what is left and rounds every configuration up, as far as there are
    items: its places get the longest items of their classes, and its last one the longest item at all that fits, so that what a
    class is too long for isn't lost. Such sequences are full but for 0.5 %. When a round places under a tenth of what was left,
    or under 3 % are left, the rest goes by best fit. Work depends on the number of different lengths, never on that of items.
    """
    need = need.astype(np.int64).copy()
    out, placed = [], 0
    if need[capacity]:
        out.append((np.array([capacity]), np.array([1]), int(need[capacity])))
        need[capacity] = 0
    pool, total, tops = _Pool(need), int(need.sum()), cells(capacity)
    which, lows = np.searchsorted(tops, np.arange(capacity + 1)), np.append(1, tops[:-1] + 1)
    while (before := sum(pool.left)) > 0.03 * total:
        counts = np.bincount(which, weights=np.array(pool.left), minlength=len(tops)).astype(np.int64)
        some = np.flatnonzero(counts)
        for keys, m, x in sorted(multiplicative_weights(counts[some], tops[some], capacity, rate), key=lambda c: (-c[2], c[0].tobytes(), c[1].tobytes())):
            places = [some[g] for g, n in zip(keys[::-1].tolist(), m[::-1].tolist(), strict=True) for _ in range(n)]
            wanted = int(np.ceil(x - 1e-9))
            while wanted > 0:
                used: dict[int, int] = {}
                for g in places[:-1]:
                    item = pool.longest(int(tops[g]), used)
                    if item < lows[g]:
                        break
                    used[item] = used.get(item, 0) + 1
                else:
                    room = pool.finish(used, capacity - sum(k * n for k, n in used.items()))
                    if used and room <= 0.005 * capacity:
                        out.append(pool.take(used, wanted))
                        wanted -= out[-1][2]
                        placed += out[-1][2] * sum(used.values())
                        continue
                break
        if sum(pool.left) > 0.9 * before:
            break
    while any(pool.left):
        used = {}
        pool.finish(used, capacity)
        out.append(pool.take(used, total))
    return out, placed


def layout(configs: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Slots as intervals: the r-th piece of a length lies in the interval of that length that holds r."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for keys, m, times in configs:
        offset = 0
        for length, k in zip(keys.tolist(), m.tolist(), strict=True):
            first = used.get(length, 0)
            rows.append((length, first, k, sequence, offset))
            used[length] = first + k * times
            offset += k * length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "first": table[:, 1], "per": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4], "sequences": np.array([sequence])}


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Each text's ids and end_id, cut into pieces of capacity ids (the last may be shorter). Null text is empty: just end_id."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for s in slices(batch, max_rows=2048):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, b in zip(s.column("doc_id").to_pylist(), enc.encode(s.column("text")), strict=True):
                    b += end
                    for k, at in enumerate(range(0, len(b), 4 * capacity)):
                        part = b[at : at + 4 * capacity]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return texts_of(docs).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_group: int = 2_000) -> DataFrame:
    """Add sequence_id and offset to pieces (columns length, doc_id, piece and any more).

    The driver sees only the histogram (capacity rows at most) and makes a table of slots whose size depends on it alone. A
    piece finds its slot by its rank among those of its length; ranks are counted within hashed groups of a length, so that a
    length which a third of all pieces have is spread out. pieces is read three times, so give a stored table.
    """
    spark = pieces.sparkSession
    need = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        need[r["length"]] = r["count"]
    total = int(need.sum())
    slots = spark.sparkContext.broadcast(layout(solve(need, capacity)[0]))
    groups = max(1, total // rows_per_group)
    grouped = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counts = grouped.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    ahead = counts.select("length", "_g", (F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = grouped.withColumn("_rank", rank).join(ahead, ["length", "_g"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_ahead")).drop("_g", "_ahead")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        key = s["length"] << 40 | s["first"]
        for batch in batches:
            length, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            k = np.searchsorted(key, length << 40 | r, "right") - 1
            within = r - s["first"][k]
            cols = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_rank"]
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s["sequence"][k] + within // s["per"][k]), pa.array(s["offset"][k] + within % s["per"][k] * length)], [*names, "sequence_id", "offset"])

    out = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their sequence and their place in it; with_ids adds the ids as little-endian unsigned 32-bit integers.

    Null text is empty and has the one id end_id; texts of any length are cut into pieces. Repeated rows are packed as often as they
    occur, columns other than doc_id and text don't matter, whatever their names, and an empty table gives an empty result.
    Sequences are gapless from offset 0.
    """
    pieces = stored(token_pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every text of documents into sequences of 4096 ids."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
