"""Operator 7: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, seeds, mix, slices, span_hashes, texts_of, utf8, words

N, SEEDS, THRESHOLD = 2, 4, 0.65
#: Items of fewer words are copied only where all of their words stand in a row.
SHORT = 8
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Words of test items in one block: each block is broadcast, and a larger benchmark takes several passes.
BLOCK_WORDS = 1_000_000
#: Places of seeds in texts and items that are held at once.
PAIRS = 2_000_000


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words in order, and where each row's begin: runs of letters and digits, ASCII ones in lower case.

    Characters of scripts without spaces (kana and ideographs, that is lead bytes E3 to E9; Thai and Lao, E0 B8 to E0 BB) are a word
    each.
    """
    data, offsets = utf8(column)
    solid = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    s, e, row = words(np.where(solid, data, 32).astype(np.uint8), offsets)
    lead = (data >= 0xE3) & (data <= 0xE9)
    lead[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    if lead.any():
        at = np.flatnonzero(lead)
        begins = np.zeros(len(data) + 1, bool)
        begins[s] = begins[at] = True
        begins[at[solid[np.minimum(at + 3, len(data) - 1)]] + 3] = True
        starts = np.flatnonzero(begins[:-1])
        run = np.searchsorted(s, starts, "right") - 1
        s, e, row = starts, np.minimum(np.append(starts[1:], len(data)), e[run]), row[run]
    return span_hashes(data, s, e, fold=True), np.searchsorted(row, np.arange(len(offsets)))


def grams(h: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within rows, and where each starts in h."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    factors = seeds(n, 31) | U64(1)
    g = np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        g += h[j : j + len(g)] * factors[j]
    row = np.searchsorted(begins, np.arange(len(h)), "right")
    at = np.flatnonzero(row[: len(g)] == row[n - 1 :])
    return mix(g[at]), at


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Smith-Waterman score of two word sequences over that of the item with itself: 1 for a verbatim copy."""
    best, steps = 0.0, np.arange(len(window) + 1) * -GAP
    above = np.zeros(len(window) + 1)
    for x in item:
        row = np.empty(len(window) + 1)
        row[0] = 0.0
        row[1:] = np.maximum(above[:-1] + np.where(window == x, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0.0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps within the row
        best = max(best, float(row.max()))
        above = row
    return best / (MATCH * len(item))


class Block:
    """Test items of one block: their words, and their n-grams with the places where they occur.

    An alignment of m matching words in k runs scores 2 m - (k - 1) at most, so that one of least * 2 * size or more holds
    m - k >= (2 * least - 1) * size - 1 of the item's pairs of words. Where that isn't above 0, single words serve: there are
    least * size of them. So many n-grams of every item stand in each copy: its most common ones but for these needn't be looked up.
    """

    def __init__(self, rows: list[tuple[int, str]], threshold: float, short: int):
        h, begins = word_hashes(pa.array([t for _, t in rows], pa.large_string()))
        items = [(i, h[a:b]) for (i, _), a, b in zip(rows, begins[:-1].tolist(), begins[1:].tolist(), strict=True) if b > a]
        self.ids, self.items = [i for i, _ in items], [w for _, w in items]
        self.sizes = np.array([len(w) for w in self.items], np.int64)
        self.least = np.where(self.sizes < short, 1.0, threshold)
        flat = np.concatenate(self.items) if items else np.zeros(0, U64)
        starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        pairs = np.ceil((2 * self.least - 1) * self.sizes - 1 - 1e-9).astype(np.int64)
        single = pairs < 1
        self.need = np.where(single, np.maximum(1, np.ceil(self.least * self.sizes - 1e-9)), pairs).astype(np.int64)
        self.has_words = bool(single.any())
        g, at = self.grams_of(flat, starts)
        own = np.searchsorted(starts, at, "right") - 1
        ok = single[own] == (np.arange(len(g)) >= len(g) - len(flat)) if self.has_words else slice(None)
        self.gram_item = own[ok]
        self.gram_place = at[ok] - starts[self.gram_item]
        self.grams, self.gram_of = np.unique(g[ok], return_inverse=True)

    def grams_of(self, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words, then single words if any item is looked up by them."""
        g, at = grams(h, begins, N)
        return (np.concatenate([g, h]), np.concatenate([at, np.arange(len(h))])) if self.has_words else (g, at)

    def keep_seeds(self, df: np.ndarray) -> None:
        """So many n-grams of each item stay, those that the fewest documents hold, that any copy has SEEDS of them (or all it needs)."""
        order = np.lexsort((self.gram_place, df[self.gram_of], self.gram_item))
        rank = np.arange(len(order)) - np.searchsorted(self.gram_item[order], self.gram_item[order], "left")
        self.held = np.minimum(self.need, SEEDS)
        number = np.bincount(self.gram_item, minlength=len(self.items)) - self.need + self.held
        keep = order[rank < number[self.gram_item[order]]]
        item, place, g = self.gram_item[keep], self.gram_place[keep], self.grams[self.gram_of[keep]]
        order = np.argsort(g, kind="stable")
        self.gram_item, self.gram_place = item[order], place[order]
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(order))

    def matches(self, h: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Rows and items of which a copy stands in the row's words, with their scores."""
        k, at = _known(self, h, begins)
        if not len(k):
            return
        order = np.argsort(at, kind="stable")
        k, at = k[order], at[order]
        many = np.cumsum(self.first[k + 1] - self.first[k])
        row = np.searchsorted(begins, at, "right") - 1
        a = 0
        while a < len(k):  # whole rows, of about PAIRS pairs of places
            b = int(np.searchsorted(many, (many[a - 1] if a else 0) + PAIRS, "right"))
            b = int(np.searchsorted(row, row[min(max(b, a + 1), len(k)) - 1], "right"))
            yield from self._candidates(h, begins, k[a:b], at[a:b], row[a:b])
            a = b

    def _candidates(self, h: np.ndarray, begins: np.ndarray, k: np.ndarray, at: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, float]]:
        times = self.first[k + 1] - self.first[k]
        x = np.repeat(self.first[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        item, place, n = self.gram_item[x], self.gram_place[x], len(self.items)
        key = np.repeat(row, times) * n + item
        start = np.repeat(at, times) - place
        longest = int(self.sizes.max()) + 1
        which, count = np.unique(np.unique(key * longest + place) // longest, return_counts=True)
        which = which[count >= self.held[which % n]]
        ok = np.flatnonzero(np.isin(key, which))
        ok = ok[np.lexsort((start[ok], key[ok]))]
        key, start, place = key[ok], start[ok], place[ok]
        edges = np.append(np.searchsorted(key, which), len(key)).tolist()
        for j, w in enumerate(which.tolist()):
            r, i = divmod(w, n)
            score = self._score(h, int(begins[r]), int(begins[r + 1]), i, start[edges[j] : edges[j + 1]], place[edges[j] : edges[j + 1]])
            if score >= self.least[i]:
                yield r, self.ids[i], score

    def _score(self, h: np.ndarray, begin: int, end: int, i: int, start: np.ndarray, place: np.ndarray) -> float:
        """The best score of item i around seeds in ascending order of start. A copy takes in (1 - least) * 2 * size more words at most."""
        own, size, least = self.items[i], int(self.sizes[i]), float(self.least[i])
        slack = int(2 * (1 - least) * size + 1e-9)
        kinds, need = np.unique(own, return_counts=True)
        best, at = 0.0, 0
        while at < len(start):  # seeds within one step share a window, that holds every copy around any of them
            s = int(start[at])
            upto = int(np.searchsorted(start, s + slack, "right"))
            far = slice(int(np.searchsorted(start, s - slack)), int(np.searchsorted(start, s + 2 * slack, "right")))
            at = upto
            if len(start[far]) < self.held[i] or len(np.unique(place[far])) < self.held[i]:
                continue
            window = h[max(begin, s - slack) : min(end, s + 2 * slack + size)]
            k = np.minimum(np.searchsorted(kinds, window), len(kinds) - 1)
            common = np.minimum(np.bincount(k[kinds[k] == window], minlength=len(kinds)), need).sum()
            if common >= least * size - 1e-9:  # no alignment can score more than its common words
                best = max(best, align(own, window))
            if best >= 1.0:
                break
        return best


def item_blocks(benchmark: DataFrame, threshold: float, short: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of about block_words words, one in the driver at a time. Null and repeated rows count once or not at all."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield Block(sorted((r["item_id"], r["text"]) for r in part.collect()), threshold, short)


def _known(block: Block, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the block's n-grams, and where they start in h."""
    g, at = block.grams_of(h, begins)
    if not len(block.grams) or not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(block.grams, g), len(block.grams) - 1)
    ok = block.grams[k] == g
    return k[ok], at[ok]


def _frequencies(docs: DataFrame, block: Block) -> np.ndarray:
    """How many texts hold each n-gram of the block; a task gives one row for each n-gram at most."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros(len(b.grams), np.int64)
        for batch in batches:
            for s in slices(batch):
                h, begins = word_hashes(s.column("text"))
                k, at = _known(b, h, begins)
                row = np.searchsorted(begins, at, "right") - 1
                if len(k):
                    total += np.bincount(np.unique(row * len(total) + k) % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    df = np.zeros(len(block.grams), np.int64)
    for r in docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"]] = r["n"]
    return df


def _search(docs: DataFrame, block: Block) -> DataFrame:
    """docs with the items of a block appended to item_ids and scores."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for s in slices(batch):
                h, begins = word_hashes(s.column("text"))
                ids, scores = s.column("item_ids").to_pylist(), s.column("scores").to_pylist()
                for row, item, score in sorted(b.matches(h, begins)):
                    ids[row] = ids[row] + [item]
                    scores[row] = scores[row] + [score]
                cols = {"item_ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))}
                yield pa.RecordBatch.from_arrays([cols.get(c, s.column(c)) for c in s.schema.names], s.schema.names)

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, short: int = SHORT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: row (a struct of its columns), item_ids and scores of the test items that its text holds a copy of.

    Of every item so many pairs of words, those that the fewest documents hold, are looked up in all whole texts that no copy can be
    without them, wherever its edits are. Around these seeds the item is aligned with the text, by words; a copy scores threshold
    or more of a verbatim one. Items of fewer than short words must stand there word for word; items without words are in no text.
    A null text is empty and holds nothing; nulls elsewhere don't matter; repeated rows and items have equal results. Texts may be of
    any length, columns of docs may have any name, and empty tables are fine on either side. Texts aren't shuffled: each block of the
    benchmark takes two scans, the second of which adds to the arrays.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = out.select("text")
    out = out.withColumn("item_ids", F.expr("cast(array() as array<bigint>)")).withColumn("scores", F.expr("cast(array() as array<double>)"))
    for block in item_blocks(benchmark, threshold, short, block_words):
        block.keep_seeds(_frequencies(texts, block))
        out = _search(out, block)
    return out.select("row", "item_ids", "scores")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold copies of benchmark items: doc_id, contaminated, item_ids and the best score (0 if none)."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", best.alias("score"))
