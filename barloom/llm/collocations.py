"""Operator 11: phrase collocations from vertical positional inverted lists.

The corpus is cut into blocks of about half a million words. A block holds, for each phrase, the ascending list of places where it begins:
the lists of a level (phrases of k words) stand one after the other by phrase. A level is extended by merging each list with the
postings of the word that follows; the length of the new list is the phrase's exact count in the block, and a shuffle of (phrase,
count) by ranges of phrase hashes adds the counts of all blocks up. Lists of phrases that are too rare go, and the rest is extended
again. Blocks are rows of tables that are bucketed by block, so that only what was counted and found is shuffled, and no task holds
more than a block or a range of hashes.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, mix, read_table, seeds, shuffles_deleted, slices, span_hashes, stored, utf8

#: Words of a block, counts from which a phrase is frequent, words of the longest phrase, and rows that each language reports.
BLOCK_WORDS, LEAST, LONGEST, TOP = 1 << 19, 100, 5, 2000
#: Entries (phrase, count) that one range of hashes is made for, and salts of a language's rows in joins and ranks.
RANGE_WORDS, SALTS = 1 << 22, 32
#: Bytes of text for each word of a block that a bucket gets (two blocks or so), and most buckets that Spark allows by default.
BUCKET_BYTES, BUCKETS = 16, 100_000
_FACTORS = seeds(LONGEST + 1, 11) | U64(1)
_BREAKS = np.zeros(256, bool)
_BREAKS[[10, 11, 12, 13, *b".,;:!?"]] = True
_OUTSIDE = _BREAKS.copy()
_OUTSIDE[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLOCKS = "block long, langs array<string>, n_words array<long>, body binary"
COUNTS = "range int, block long, phrases binary, counts binary"
FOUND = "block long, range int, kept binary, totals binary, told binary"
PHRASES = "lang string, phrase string, a long, lefts array<long>, rights array<long>, closed boolean"


def _planes(x: np.ndarray) -> bytes:
    """Steps of an array of integers, all first bytes before all second ones: small steps leave planes of zeros to the codec."""
    step = x.copy()
    step[1:] -= x[:-1]
    return step.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _whole(raw: bytes | np.ndarray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind)[:, 0], dtype=kind)


def _packed(**arrays: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, **{f"{k}:{x.dtype.str}": x if x.itemsize == 1 else np.frombuffer(_planes(x), np.uint8) for k, x in arrays.items()})
    return held.getvalue()


def _unpacked(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body), allow_pickle=False) as f:
        named = {k: k.split(":") for k in f.files}
        return {name: f[k] if kind.endswith("1") else _whole(f[k], kind) for k, (name, kind) in named.items()}


def _edges(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Where each range begins among ascending keys: ranges are stretches of the upper half of the hash."""
    return np.searchsorted(((keys >> U64(32)) * U64(n_ranges)) >> U64(32), np.arange(n_ranges + 1, dtype=U64))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and places of the words of some texts. Places are consecutive within a piece and skip one number between."""
    n = len(data)
    solid = ~_OUTSIDE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAKS[data])[starts] + row if n else starts
    places = np.arange(len(starts), dtype=np.int64)
    if len(starts):
        places[1:] += np.cumsum(piece[1:] != piece[:-1])
    return starts, ends, row, places


def _firsts(ranked: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return np.flatnonzero(fresh)


def _lists(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists: distinct keys ascending, their lengths, and the places by key; also which entry came first of each key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begin = _firsts(ranked)
    return ranked[begin], np.diff(np.append(begin, len(ranked))), places[order], order[begin]


class _Builder:
    """Gathers words of texts until a block is full."""

    def __init__(self, block: int):
        self.block, self.held, self.size = block, [], 0
        self.langs: dict[str, int] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = utf8(batch.column("text"))
        starts, ends, row, places = word_places(data, offsets)
        code = np.array([self.langs.setdefault(x, len(self.langs)) for x in batch.column("lang").to_pylist()], np.int64)
        low = _LOWER[data]
        # the language is part of a word's hash, so that equal words of two languages are two phrases
        salt = np.array([int(x.as_py()) & ((1 << 64) - 1) for x in batch.column("salt")], U64)
        words = mix(span_hashes(low, starts, ends) ^ salt[row])
        keys, lengths, where, one = _lists(words, places + self.size)
        text = low.tobytes()
        self.held.append((keys, lengths, where.astype(np.int64), [text[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], code[row[one]]))
        self.size += int(places[-1]) + 2 if len(places) else 0

    def row(self) -> tuple[int, list[str], list[int], bytes]:
        """The block: postings of its words, their bytes and languages."""
        keys = np.concatenate([h[0] for h in self.held])
        lengths = np.concatenate([h[1] for h in self.held])
        texts = [t for h in self.held for t in h[3]]
        langs = np.concatenate([h[4] for h in self.held])
        order = np.argsort(keys, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        places = np.concatenate([h[2] for h in self.held])[at]
        first = _firsts(keys[order])
        total = np.add.reduceat(size, first) if len(first) else size
        n_words = np.bincount(langs, lengths, len(self.langs)).astype(np.int64).tolist()
        kept = order[first]
        body = _packed(words=np.frombuffer(b" ".join([texts[k] for k in kept.tolist()]), np.uint8), lang=langs[kept], keys1=keys[kept], sizes1=total.astype(np.int32), places1=places.astype(np.int32))
        return self.block, list(self.langs), n_words, body


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Postings of the words of each block. A block ends with the text that fills it, so that texts may be of any length."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("salt", F.xxhash64("lang"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        now = _Builder(number)
        for batch in batches:
            for s in slices(batch):
                now.add(s)
                if now.size >= block_words:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), _TYPES, strict=True)], ["block", "langs", "n_words", "body"])
                    number += 1
                    now = _Builder(number)
        if now.held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), _TYPES, strict=True)], ["block", "langs", "n_words", "body"])

    return texts.mapInArrow(make, BLOCKS)


_TYPES = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]


def extended(held: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lengths and places of the lists of k words: those of k - 1 words merged with the postings of the word that follows.

    Both begin and end of a frequent phrase are frequent, so a place stays only where a list of k - 1 words has the next place too.
    """
    if k == 1:
        return held["keys1"], held["sizes1"].astype(np.int64), held["places1"]
    places, sizes = held[f"places{k - 1}"], held[f"sizes{k - 1}"]
    end = int(held["places1"].max(initial=-1)) + LONGEST + 1
    word = np.full(end, -1, np.int32)
    word[held["places1"]] = np.repeat(np.arange(len(held["keys1"]), dtype=np.int32), held["sizes1"])
    begins = np.zeros(end, bool)
    begins[places] = True
    here = begins[places + 1]
    following = word[places[here] + k - 1]
    before = np.repeat(held[f"keys{k - 1}"], sizes)[here]
    keys, lengths, where, _ = _lists(mix(before * _FACTORS[k] + held["keys1"][following]), places[here])
    return keys, lengths, where


def _counts(k: int, n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                keys, lengths, _ = extended(_unpacked(body.as_py()), k)
                edges = _edges(keys, n_ranges)
                full = np.flatnonzero(np.diff(edges))
                cut = lambda x: pa.array([_planes(x[edges[r] : edges[r + 1]]) for r in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), cut(keys), cut(lengths.astype(np.int32))], ["range", "block", "phrases", "counts"])

    return run


def _add_up(least: int):
    """Exact counts of the phrases of a range; each block hears which of its own are frequent (a bit for each, in their order) and their
    counts. One block, which the hash of phrase and block picks, is to tell about the phrase in the end."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        parts = [_whole(p.as_buffer(), "<u8") for p in table.column("phrases")]
        keys, owner = np.concatenate(parts), np.repeat(np.arange(len(blocks)), [len(p) for p in parts])
        n = np.concatenate([_whole(p.as_buffer(), "<i4") for p in table.column("counts")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = _firsts(keys[order])
        total = np.add.reduceat(n[order], first) if len(first) else n
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        kept = total[group] >= least
        at = np.flatnonzero(kept)
        chance = mix(keys[at] ^ mix(blocks[owner[at]].astype(U64)))
        by = np.lexsort((owner[at], chance, group[at]))
        told = np.zeros(len(keys), bool)
        told[at[by[_firsts(group[at][by])]]] = True
        edges = np.searchsorted(owner, np.arange(len(blocks) + 1))
        rows = []
        for r in range(len(blocks)):
            own = slice(edges[r], edges[r + 1])
            if kept[own].any():
                rows.append((np.packbits(kept[own]).tobytes(), _planes(total[group[own][kept[own]]]), np.packbits(told[own][kept[own]]).tobytes(), int(blocks[r])))
        return pa.table([pa.array([r[3] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()), *[pa.array([r[j] for r in rows], pa.binary()) for j in range(3)]], ["block", "range", "kept", "totals", "told"])

    return run


def _filter(k: int, n_ranges: int):
    """A block with the lists of k words that are frequent. With those of two words, words go that no list holds any more."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(["block", "langs", "n_words", "body"])
        held = _unpacked(table.column("body")[0].as_py())
        keys, sizes, places = extended(held, k)
        edges = _edges(keys, n_ranges)
        stays, totals, told = np.zeros(len(keys), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for r in found.sort_by("range").to_pylist():
            a, b = edges[r["range"]], edges[r["range"] + 1]
            stays[a:b] = np.unpackbits(np.frombuffer(r["kept"], np.uint8), count=b - a)
            totals.append(_whole(r["totals"], "<i8"))
            told.append(np.unpackbits(np.frombuffer(r["told"], np.uint8), count=len(totals[-1])))
        held |= {f"keys{k}": keys[stays], f"sizes{k}": sizes[stays].astype(np.int32), f"places{k}": places[np.repeat(stays, sizes)].astype(np.int32), f"total{k}": np.concatenate(totals), f"told{k}": np.concatenate(told)}
        if k == 1:
            texts = held["words"].tobytes().split(b" ")
            held |= {"words": np.frombuffer(b" ".join([texts[x] for x in np.flatnonzero(stays).tolist()]), np.uint8), "lang": held["lang"][stays]}
        if k == 2:
            near = np.zeros(int(held["places1"].max(initial=-1)) + 2, bool)
            near[held["places2"]] = near[held["places2"] + 1] = True
            alive = near[held["places1"]]
            ends = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], np.cumsum(held["sizes1"])])]
            held |= {"places1": held["places1"][alive], "sizes1": np.diff(ends).astype(np.int32)}
        return table.select(["block", "langs", "n_words"]).append_column("body", pa.array([_packed(**held)], pa.binary()))

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases that each block is to tell about, with the counts of both parts of every cut; closed: some longer phrase around
    it is as frequent. A longer phrase with the same count covers all its places, so one word more on either side shows it."""
    for batch in batches:
        for langs, body in zip(batch.column("langs").to_pylist(), batch.column("body"), strict=True):
            held = _unpacked(body.as_py())
            end = int(held["places1"].max(initial=-1)) + LONGEST + 2
            totals = {}
            for k in range(1, LONGEST + 1):
                totals[k] = np.zeros(end, np.int64)
                totals[k][held[f"places{k}"]] = np.repeat(held[f"total{k}"], held[f"sizes{k}"])
            word = np.full(end, -1, np.int64)
            word[held["places1"]] = np.repeat(np.arange(len(held["keys1"])), held["sizes1"])
            texts = [x.decode() for x in held["words"].tobytes().split(b" ")]
            for k in range(2, LONGEST + 1):
                sizes = held[f"sizes{k}"].astype(np.int64)
                at = held[f"places{k}"][(np.cumsum(sizes) - sizes)[held[f"told{k}"] > 0]].astype(np.int64)
                if not len(at):
                    continue
                a = totals[k][at]
                closed = np.zeros(len(at), bool)
                if k < LONGEST:
                    closed = (totals[k + 1][at] == a) | ((at > 0) & (totals[k + 1][at - 1] == a))
                phrases = [" ".join([texts[w] for w in row]) for row in word[at[:, None] + np.arange(k)].tolist()]
                lang = [langs[x] for x in held["lang"][word[at]].tolist()]
                cuts = np.arange(0, (k - 1) * len(at) + 1, k - 1, dtype=np.int32)
                lefts = np.stack([totals[j][at] for j in range(1, k)], 1).ravel()
                rights = np.stack([totals[k - j][at + j] for j in range(1, k)], 1).ravel()
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (lefts, rights)]
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrases, pa.string()), pa.array(a), *lists, pa.array(closed)], ["lang", "phrase", "a", "lefts", "rights", "closed"])


def _bucketed(df: DataFrame, n: int) -> tuple[DataFrame, str]:
    """df as a table of the warehouse in n buckets by block, and its name."""
    name = f"barloom_phrases_{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.bucketBy(n, "block").option("compression", "zstd").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name), name


def frequent_phrases(docs: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to 5 words that come up least times or more in their language, and (lang, n), the words of each language.

    lefts and rights are the counts of the parts before and after each cut. Phrases are known by 64-bit hashes on the way.
    """
    spark, made = docs.sparkSession, blocks(docs, block_words)
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task holds the blocks of a bucket, so there are as many as the text asks for, however it is split
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_buckets = min(BUCKETS, max(at_once, n_bytes // (BUCKET_BYTES * block_words)))
    state, name = _bucketed(made, n_buckets)
    n_words = stored(state.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n_words").alias("n")), "phrase-words")
    n_ranges = max(at_once, (n_words.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS)
    for k in range(1, LONGEST + 1):
        counts = state.select("block", "body").mapInArrow(_counts(k, n_ranges), COUNTS)
        found = counts.groupBy("range").applyInArrow(_add_up(least), FOUND).withColumnRenamed("block", "to")
        longer = state.groupBy("block").cogroup(found.groupBy("to")).applyInArrow(_filter(k, n_ranges), BLOCKS)
        (state, name), before = _bucketed(longer, n_buckets), name
        spark.sql(f"DROP TABLE {before}")
    phrases = stored(state.select("langs", "body").mapInArrow(_told, PHRASES), "phrases")
    spark.sql(f"DROP TABLE {name}")
    return phrases, n_words


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the lowest floor(1000 a n / (l r)) of its cuts, the first cut of equal ones; phrases with a longer one around
    them that is as frequent don't count. Rows of docs need lang (null: und) and text (null: empty); repeated rows count each, empty
    and very long texts and an empty table are no exception, and other columns of any name are left alone. Equal scores go by a, then
    by phrase in byte order, and phrases are distinct within a language, so ranks have no ties.
    """
    phrases, n_words = frequent_phrases(docs, least, block_words)
    phrases = phrases.filter("not closed").withColumn("salt", F.expr(f"pmod(hash(phrase), {SALTS})"))
    n = n_words.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    whole = lambda x: f"cast({x} as decimal(38, 0))"
    score = f"(1000 * {whole('a')} * {whole('n')}) div ({whole('x.lefts')} * {whole('x.rights')})"
    cuts = F.expr(f"transform(arrays_zip(lefts, rights), (x, k) -> struct({score} as score, k as cut, x.lefts as l, x.rights as r))")
    scored = phrases.join(n, ["lang", "salt"]).withColumn("x", F.array_min(cuts)).select("lang", "salt", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of documents, by language."""
    return collocations(read_table(spark, sf_dir, "documents"))
