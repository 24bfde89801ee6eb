"""Collocations against a plain count; the query is compared with SQL too."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import collocations as co


def plain(docs, least, top=2000):
    """Rows of collocations(), counted phrase by phrase."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    rows = {}
    for (lang, p), a in f.items():
        around = [q for (g, q), c in f.items() if g == lang and len(q) == len(p) + 1 and c >= a and p in (q[1:], q[:-1])]
        if len(p) > 1 and not around:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])}


def documents(n=400, seed=3):
    rng = random.Random(seed)
    words = ["Red", "fish", "blue", "Ä", "ä", "é", "na", "ROW", "row", "x", "long-word", "日本"]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randrange(0, 12))) + rng.choice([".", ", ", "!?", "\n", "\t", " ", "\r\n"]) for _ in range(6)]
        out.append((rng.choice(["en", "en", "de", None, "und"]), "".join(parts) + rng.choice(["the same passage of several words here.", "one two three four five six"])))
    return [*out, ("en", None), (None, ""), ("en", "..,,!!\n"), ("de", "one"), ("en", "a " * 3000 + "b"), *[("fr", "tie a b. tie c d.")] * 30]


@pytest.mark.parametrize("block_words", [150, 1 << 19])
def test_against_a_plain_count(spark, block_words):
    docs = documents()
    rows = [(k % 50, t, g, "x", "y") for k, (g, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, block string, phrases string").repartition(3)
    got = {tuple(r) for r in co.collocations(df, least=20, block_words=block_words).collect()}
    assert got == plain(docs, 20) and len(got) > 50


def test_only_the_best_are_told(spark):
    docs = documents(120)
    df = spark.createDataFrame([(t, g) for g, t in docs], "text string, lang string")
    assert {tuple(r) for r in co.collocations(df, least=8, top=5).collect()} == plain(docs, 8, 5)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("a b", "en")] * 3, "text string, lang string")
    assert co.collocations(df).count() == 0 and co.collocations(df.limit(0)).count() == 0
    assert [tuple(r) for r in co.collocations(df, least=3).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_lists_come_back_from_planes_of_bytes():
    rng = np.random.default_rng(1)
    for x in (np.array([], np.int32), rng.integers(0, 1 << 62, 1000).astype(np.uint64), rng.integers(-5, 1 << 30, 77).astype(np.int32), np.array([1 << 63, 0, (1 << 64) - 1], np.uint64)):
        assert (co._whole(co._planes(x), x.dtype.str) == x).all()
        assert (co._unpacked(co._packed(a=x, b=np.arange(3, dtype=np.uint8)))["a"] == x).all()


def test_places_skip_a_number_between_pieces():
    text = pa.array(["a b, c", "", None, "d\n\ne f"])
    from barloom.llm.common import utf8

    starts, ends, row, places = co.word_places(*utf8(text))
    assert row.tolist() == [0, 0, 0, 3, 3, 3] and np.diff(places).tolist() == [1, 2, 2, 2, 1]


@pytest.mark.parametrize("parts", [1, 3])
def test_buckets_follow_the_text_not_its_partitions(spark, monkeypatch, parts):
    """A task holds a bucket: its blocks are few however much text there is."""
    docs, made, bucketed = documents(), [], co._bucketed
    monkeypatch.setattr(co, "_bucketed", lambda df, n: made.append(n) or bucketed(df, n))
    df = spark.createDataFrame([(t, g) for g, t in docs], "text string, lang string").repartition(parts)
    assert {tuple(r) for r in co.collocations(df, least=20, block_words=300).collect()} == plain(docs, 20)
    assert min(made) >= sum(len((t or "").encode()) for _, t in docs) // (16 * 300) > 10
