"""Operator 12: how the words of each source diverge from those of the other sources and of its language.

Texts of a slice are one buffer of UTF-8 bytes. A table of 256 entries tells bytes of terms from others, xxhash groups the slices of
that buffer, and groups are verified byte by byte. Counts meet in Spark by (language, term); terms that are kept become compressed
sparse rows (sources by terms) of a few thousand terms each, whose divergences are sums over stretches of the rows (reduceat).
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, read_table, slices, stored, utf8

#: Documents of its language that a term must be in, what is added to each count, the whole of a distribution, and terms reported.
LEAST, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Entries that a task holds before it hands them on, terms of one sparse matrix, salts of a language's terms.
HELD, MATRIX_TERMS, SALTS = 1 << 21, 1 << 12, 16
_TERM = np.zeros(256, bool)
_TERM[[*string.ascii_letters.encode(), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"
Hash = Callable[[bytes], int]


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of term bytes within each row."""
    n = len(data)
    inside = _TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Hash = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the distinct terms: slices are grouped by their hash, and every one is compared with the
    first of its group byte by byte. Groups that hold different bytes are taken apart."""
    raw = data.tobytes()
    a, b = starts.tolist(), ends.tolist()
    hashes = np.fromiter((digest(raw[x:y]) for x, y in zip(a, b, strict=True)), U64, len(a))
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order][1:] != hashes[order][:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    size, like = ends - starts, one[code]
    # bytes of all slices that aren't the first of their group, against those of the first
    more = np.flatnonzero(like != np.arange(len(like)))
    differ = size[more] != size[like[more]]
    same, own = more[~differ], np.zeros(0, bool)
    begin = np.cumsum(size[same]) - size[same]
    step = np.arange(size[same].sum())
    unequal = data[np.repeat(starts[same] - begin, size[same]) + step] != data[np.repeat(starts[like[same]] - begin, size[same]) + step]
    own = np.logical_or.reduceat(unequal, begin) if len(same) else own
    terms = [raw[a[k] : b[k]] for k in one.tolist()]
    apart: dict[bytes, int] = {}
    for k in np.sort(np.concatenate([more[differ], same[own]])).tolist():
        t = raw[a[k] : b[k]]
        if t not in apart:
            apart[t] = len(terms)
            terms.append(t)
        code[k] = apart[t]
    return code, terms


class _Held:
    """Counts of (group, term) pairs that a task has come across."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = utf8(batch.column("text"))
        data = _LOWER[data]
        starts, ends, row = term_spans(data, offsets)
        code, terms = grouped(data, starts, ends)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
        number = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], np.int64)
        pairs, n = np.unique(row * max(len(terms), 1) + code, return_counts=True)  # a row's count of a term
        row, code = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
        keys, at = np.unique(group[row] << 32 | number[code], return_inverse=True)
        self.parts.append(np.stack([keys, np.bincount(at, n, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))]))
        self.size += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys, n, docs = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((3, 0), np.int64)
        order = np.argsort(keys, kind="stable")
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[order][1:] != keys[order][:-1]
        first = np.flatnonzero(fresh)
        n, docs = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, docs))
        keys = keys[order][first]
        langs, sources = pa.array([g[0] for g in self.groups], pa.string()), pa.array([g[1] for g in self.groups], pa.string())
        terms = pa.array(list(self.terms), pa.binary())
        for k in range(0, len(keys), 1 << 16):
            part = keys[k : k + (1 << 16)]
            group = pa.array(part >> 32)
            columns = [langs.take(group), sources.take(group), terms.take(pa.array(part & 0xFFFFFFFF)).cast(pa.string()), pa.array(n[k : k + len(part)]), pa.array(docs[k : k + len(part)])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts of each term in each (lang, source): occurrences, and documents that have it. Nulls are empty."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for s in slices(batch):
                held.add(s)
                if held.size >= HELD:
                    yield from held.rows()
                    held = _Held()
        yield from held.rows()

    return texts.mapInArrow(run, COUNTS)


def shares(counts: np.ndarray, total: Any, n_terms: int) -> np.ndarray:
    """1 + floor(WHOLE (count + ADDED) / (total + ADDED n_terms)), exact for counts of any size."""
    top = int(counts.max(initial=0)) + ADDED
    wide = counts.astype(object) if top * WHOLE >= 1 << 63 else counts.astype(np.int64)
    return (1 + WHOLE * (wide + ADDED) // (total + ADDED * n_terms)).astype(np.int64)


def _matrix(kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Divergences of a language's sources over some of its terms: partial sums for pairs, and the terms that stand out the most."""
    lang = groups.column("lang")[0].as_py()
    names = groups.column("source").to_pylist()
    totals, n_terms = np.array(groups.column("n_source").to_pylist(), np.int64), groups.column("n_terms")[0].as_py()
    place = {s: k for k, s in enumerate(names)}
    terms = kept.column("term").to_pylist()
    by_bytes = sorted(range(len(terms)), key=lambda k: terms[k].encode())
    terms = [terms[k] for k in by_bytes]
    cells = kept.column("cells").to_pylist()
    index = [(place[c["source"]], t, c["n"]) for t, k in enumerate(by_bytes) for c in cells[k]]
    rows, at, n = np.array(index, np.int64).reshape(-1, 3).T
    order = np.argsort(rows, kind="stable")  # compressed sparse rows: sources by terms
    rows, at, n = rows[order], at[order], n[order]
    pointer = np.searchsorted(rows, np.arange(len(names) + 1))
    full = np.flatnonzero(np.diff(pointer))
    none = shares(np.zeros(len(names), np.int64), 0, 1) if not n_terms else np.array([int(shares(np.zeros(1, np.int64), t, n_terms)[0]) for t in totals.tolist()], np.int64)
    p = np.concatenate([shares(n[pointer[k] : pointer[k + 1]], int(totals[k]), n_terms) for k in full.tolist()]) if len(full) else n
    out: dict[str, list[Any]] = {"source": [], "part": [], "item": [], "value": []}

    def emit(source: str, part: str, items: list[str], values: list[int]) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values

    for k, name in enumerate(names):
        own = slice(pointer[k], pointer[k + 1])
        line = np.full(len(terms), none[k])
        line[at[own]] = p[own]
        # all terms as if the other sources had none of them, then what their own cells change
        sums = (len(terms) - len(p[own])) * np.abs(none - none[k])
        for a in range(0, len(names), 256):
            sums[a : a + 256] += np.abs(none[a : a + 256, None] - p[own]).sum(1)
        if len(full):
            sums[full] += np.add.reduceat(np.abs(p - line[at]) - np.abs(none[rows] - line[at]), pointer[full])
        emit(name, "pair", [x for j, x in enumerate(names) if j != k], [int(x) for j, x in enumerate(sums) if j != k])
    if len(terms):
        together = shares(np.bincount(at, n, len(terms)).astype(np.int64) if n.sum() < 1 << 53 else np.array([sum(c["n"] for c in cells[k]) for k in by_bytes], np.int64), int(sum(totals.tolist())), n_terms)
        more = p - together[at]
        for k in full.tolist():
            own = np.arange(pointer[k], pointer[k + 1])
            own = own[more[own] > 0]
            best = own[np.lexsort((at[own], -more[own]))][:TOP]
            emit(names[k], "term", [terms[t] for t in at[best].tolist()], more[best].tolist())
    return pa.table([pa.array([lang] * len(out["source"]), pa.string()), *[pa.array(out[c], pa.string()) for c in ("source", "part", "item")], pa.array(out["value"], pa.int64())], ["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) of docs the distance to every other source of the language (pair)
    and the terms that it has more of than its language, the best 50 (term). Equal values go by item in byte order.

    Null text, lang and source are empty; repeated rows are documents each; texts may be empty or of any length; other columns of any
    name are left alone; an empty table gives no row, and a source that is alone in its language no pair.
    """
    # tasks have combined their counts already: one shuffle by (lang, term) serves both aggregations
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells")).filter(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "cells"), "terms")
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n_source"))
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    groups = found.join(sizes, ["lang", "source"], "left").join(n_terms, "lang", "left").fillna(0, ["n_source", "n_terms"])
    groups = stored(groups.withColumn("n_parts", F.greatest(F.ceil(F.col("n_terms") / MATRIX_TERMS), F.lit(1)).cast("int")), "sources")
    parts = groups.select("lang", "n_parts").distinct().select("lang", "n_parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = kept.withColumn("salt", F.expr(f"pmod(hash(term), {SALTS})")).join(parts, ["lang", "salt"])
    left = salted.select("lang", F.expr("cast(pmod(xxhash64(term), n_parts) as int) as part"), "term", "cells")
    right = groups.select(F.col("lang").alias("in"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("of"), "lang", "source", "n_source", "n_terms")
    made = left.groupBy("lang", "part").cogroup(right.groupBy("in", "of")).applyInArrow(_matrix, FOUND)
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return summed.withColumn("rank", rank).filter(f"part = 'pair' or rank <= {TOP}")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergences of documents."""
    return divergences(read_table(spark, sf_dir, "documents"))
