"""Operator 2: near-duplicate documents by MinHash with tensored banding, every link confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, discard, distinct_per_row, mix, seeds, shingles, slices, stored, texts_of, utf8
from .components import components

SIDES, PIECES, WIDTH = 2, 11, 3
#: A sketch keeps 4 bits of each of the first so many minima, 16 to a long.
SKETCH = 64
WORDS = [f"s{j}" for j in range(SKETCH // 16)]


def min_hashes(h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n minima for each row of hashes (rows one after the other, counts long, none empty)."""
    begins = np.cumsum(counts) - counts
    factor, shift = seeds(n, 11) | U64(1), seeds(n, 12)
    out = np.empty((len(counts), n), U64)
    x = mix(h)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((x ^ shift[j]) * factor[j], begins)
    return out


def half_keys(minima: np.ndarray, pieces: int = PIECES, width: int = WIDTH) -> np.ndarray:
    """The two small collections, pieces keys of width minima each: the first pieces columns are one side, the rest the other."""
    parts = minima.reshape(len(minima), SIDES, pieces, width)
    salt = seeds(SIDES * pieces * width, 13).reshape(SIDES, pieces, width) | U64(1)
    return mix((mix(parts) * salt).sum(axis=3, dtype=U64)).reshape(len(minima), -1).view(np.int64)


def table_keys(halves: str, pieces: int = PIECES) -> F.Column:
    """The keys of pieces**2 tables as one array: table (i, j) combines half i of one side with half j of the other."""
    return F.expr(f"transform(sequence(0, {pieces * pieces - 1}), t -> xxhash64({halves}[t div {pieces}], {halves}[{pieces} + t % {pieces}], t))")


def sketches(minima: np.ndarray) -> np.ndarray:
    """4 bits of each of SKETCH minima, 16 to a long."""
    bits = mix(minima[:, :SKETCH]).reshape(len(minima), -1, 16) & U64(15)
    return (bits << (U64(4) * np.arange(16, dtype=U64))).sum(axis=2, dtype=U64).view(np.int64)


def agreement(a: str, b: str) -> Column:
    """How many of the 4-bit fields of two sketches (columns a0, b0 and so on) are equal."""
    apart = [f"({a}{j} ^ {b}{j})" for j in range(len(WORDS))]
    fields = [f"bit_count(({x} | shiftright({x}, 1) | shiftright({x}, 2) | shiftright({x}, 3)) & 1229782938247303441L)" for x in apart]
    return F.expr(f"{SKETCH} - ({' + '.join(fields)})")


def _sketch(k: int, pieces: int, width: int):
    """For each document: set size, 128-bit hash of the set, sketch, and half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                h, counts = distinct_per_row(*shingles(*utf8(s.column("text")), k), s.num_rows)
                some = np.flatnonzero(counts)
                n = len(counts)
                sums = np.zeros((2, n), U64)
                halves = np.zeros((n, SIDES * pieces), np.int64)
                sketch = np.zeros((n, len(WORDS)), np.int64)
                if len(some):
                    begins = (np.cumsum(counts) - counts)[some]
                    for j in range(2):
                        sums[j, some] = np.add.reduceat(mix(h + U64(j + 1) * U64(0x632BE59BD9B4E019)), begins)
                    minima = min_hashes(h, counts[some], max(SKETCH, SIDES * pieces * width))
                    halves[some] = half_keys(minima[:, : SIDES * pieces * width], pieces, width)
                    sketch[some] = sketches(minima)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * halves.shape[1], pa.int32()), pa.array(halves.reshape(-1)))
                columns = [s.column("doc_id"), pa.array(counts.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in sums], *[pa.array(np.ascontiguousarray(x)) for x in sketch.T], lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h0", "h1", *WORDS, "halves"])

    return run


def _shingle_rows(k: int):
    """One row for each shingle of the sets of rows (doc_id, root, text), with the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                h, counts = distinct_per_row(*shingles(*utf8(s.column("text")), k), s.num_rows)
                own = [np.repeat(s.column(c).to_numpy(), counts) for c in ("doc_id", "root")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, np.repeat(counts, counts), h.astype(np.int64))], ["doc_id", "root", "n", "shingle"])

    return run


def _confirm(k: int, percent: int):
    """Links among rows (a, part, role, doc_id, text): within a part the centre a comes first, then the texts to hold against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, U64)
        for batch in batches:
            for s in slices(batch):
                h, counts = distinct_per_row(*shingles(*utf8(s.column("text")), k), s.num_rows)
                ends = np.cumsum(counts)
                a_out, b_out = [], []
                for a, part, role, doc, lo, hi in zip(*(s.column(c).to_pylist() for c in ("a", "part", "role", "doc_id")), (ends - counts).tolist(), ends.tolist(), strict=True):
                    mine = h[lo:hi]
                    if role == 0:
                        centre, own = (a, part), mine.copy()
                    else:
                        assert centre == (a, part)
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(mine) - both):
                            a_out.append(a)
                            b_out.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, parts: int = 32) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets are similar enough.

    Each text of a pair travels once for the pair; a centre's text goes once to each of the parts that its partners are dealt to.
    """
    dealt = pairs.withColumn("part", F.pmod(F.hash("b"), F.lit(parts)))
    partners = dealt.join(texts, dealt["b"] == texts["doc_id"]).select("a", "part", F.lit(1).alias("role"), "doc_id", "text")
    centres = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts["doc_id"]).select("a", "part", F.lit(0).alias("role"), "doc_id", "text")
    rows = centres.union(partners)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(_confirm(k, percent), "a long, b long")


def across(opened: DataFrame, texts: DataFrame, sides: DataFrame, possible: Column, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents with different roots whose shared shingles may be enough for a link; no such pair is left out.

    All documents order their shingles alike: first those that no other root holds, then by how many documents hold them. Two sets
    that are similar enough share a shingle that stands so early in both that what follows is enough for the overlap they need. So
    only such first parts are joined, each shingle with the number of those that follow it. Documents that are just too far apart
    have mostly edits of their own in these parts, and meet nobody there.
    """
    rows = opened.join(texts, "doc_id").select("doc_id", "root", "text").mapInArrow(_shingle_rows(k), "doc_id long, root long, n long, shingle long")
    rows = stored(rows, "open-shingles")
    held = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("shingle", "df")
    own = Window.partitionBy("doc_id")
    #: shingles from this one on, in the common order
    left = F.count("*").over(own) - F.row_number().over(own.orderBy("df", "shingle")) + 1
    first = rows.join(held, "shingle").withColumn("left", left).filter(F.lit(100) * F.col("left") >= F.lit(percent) * F.col("n"))
    first = stored(first.select("doc_id", "root", "shingle", "left").join(sides, "doc_id"), "first-shingles")

    def side(name: str) -> DataFrame:
        return first.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in first.columns if c != "shingle"])

    enough = F.lit(100 + percent) * F.least("a_left", "b_left") >= F.lit(percent) * (F.col("a_n_shingles") + F.col("b_n_shingles"))
    pairs = side("a").join(side("b"), "shingle").filter((F.col("a_root") < F.col("b_root")) & enough & possible)
    return pairs.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, pieces: int = PIECES, width: int = WIDTH, least_alike: int = 38, centres_each: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct k-word shingles, or the whole sequence if
    it is shorter. Two documents are linked if 100 * common >= percent * union.

    1. Equal sets collapse to their smallest doc_id.
    2. pieces**2 tables are keyed by pairs of pieces from two collections of pieces * width minima each. Keys held by one
       document alone go at once. A pair at the threshold shares a key but for 8 cases in ten thousand.
    3. In each bucket the document with most bucket mates is the centre. Each document is held against the centres_each best
       of its centres; links join components.
    4. Documents of buckets that still hold several components are held against the others of them by their rarest shared
       shingles (see across), which misses no link. So a large group of documents that are alike below the threshold makes few pairs.
    5. Pairs must agree in least_alike of the 64 fields of their sketches (a pair at the threshold fails that once in a hundred
       thousand), and all are confirmed on whole sets before they count.

    Null text is empty; an empty set is linked with nothing; repeated rows are one another's copies. Rows with one doc_id and
    different texts share one fate, that of their smallest text where sets differ. doc_id should not be null: such rows come back
    unlinked, with component_id null and kept true. Texts may be of any length, an empty table gives no row, and other columns are
    ignored, whatever their names.
    """
    docs = texts_of(docs)
    sets = stored(docs.mapInArrow(_sketch(k, pieces, width), f"doc_id long, n_shingles long, h0 long, h1 long, {', '.join(f'{w} long' for w in WORDS)}, halves array<long>"), "sketches")
    some = sets.filter("n_shingles > 0 and doc_id is not null")
    # equal sets: the smallest doc_id stands for them (combined before the shuffle, so a huge group is one row for each task)
    first = some.groupBy("n_shingles", "h0", "h1").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", *WORDS, "halves")).alias("r"))
    same = stored(first.select("n_shingles", "h0", "h1", "copies", "r.*"), "classes")
    keys = same.select("doc_id", F.explode(table_keys("halves", pieces)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(keys.join(shared, "key"), "buckets")
    mates = stored(buckets.groupBy("doc_id").agg(F.sum("n").alias("mates")), "mates")
    texts = stored(docs.join(mates.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "candidates")
    sides = same.groupBy("doc_id").agg(F.min(F.struct("n_shingles", *WORDS)).alias("r")).select("doc_id", "r.*")

    def side(name: str) -> DataFrame:
        return sides.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in sides.columns if c != "doc_id"])

    #: Set sizes and sketches allow a link.
    possible = (F.lit(100) * F.least("a_n_shingles", "b_n_shingles") >= F.lit(percent) * F.greatest("a_n_shingles", "b_n_shingles")) & (agreement("a_s", "b_s") >= least_alike)

    # a few pairs a document: the centres with most mates among those of its buckets, of which it has one for each table at most
    best = buckets.join(mates, "doc_id").groupBy("key").agg(F.max(F.struct("mates", F.negative("doc_id").alias("low"))).alias("c"))
    spokes = buckets.select("key", "doc_id").join(best.select("key", "c.mates", F.negative("c.low").alias("a")), "key").filter("doc_id <> a")
    few = spokes.groupBy(F.col("doc_id").alias("b")).agg(F.slice(F.array_sort(F.collect_set(F.struct(F.negative("mates").alias("m"), "a"))), 1, centres_each).alias("c"))
    dealt = stored(few.select(F.explode("c.a").alias("a"), "b").withColumn("salt", F.pmod(F.hash("b"), F.lit(16))), "spokes")
    # a centre may have very many spokes, so its side goes to each salt that they have
    hubs = dealt.select("a", "salt").distinct().join(side("a"), "a")
    pairs = stored(dealt.join(hubs, ["a", "salt"]).join(side("b"), "b").filter(possible).select("a", "b"), "pairs")
    links = stored(confirmed(pairs, texts, k, percent), "links")
    roots = components(links)
    # what that leaves apart: the documents of buckets that hold several components
    rooted = buckets.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    opened = stored(rooted.join(several, "key").select("doc_id", "root").distinct(), "open")
    discard(buckets, mates, dealt, pairs, links)
    pairs = stored(across(opened, texts, sides, possible, k, percent), "across")
    links = stored(confirmed(pairs, texts, k, percent), "links")
    roots = components(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    discard(opened, pairs, links, texts)
    # membership: the document that stands for the equal sets, then its root; copied classes are spread over the salts
    member = some.select("doc_id", "n_shingles", "h0", "h1", F.pmod(F.hash("doc_id"), F.lit(16)).alias("salt"))
    spread = same.filter("copies > 1").select("n_shingles", "h0", "h1", F.col("doc_id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    placed = member.join(spread, ["n_shingles", "h0", "h1", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    placed = placed.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: four-word shingles, similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
