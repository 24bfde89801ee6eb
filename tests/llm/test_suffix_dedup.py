import hashlib
import random

import numpy as np
import pytest

from barloom.llm.suffix_dedup import WINDOW, anchored, dedup_substrings, lowest_holders, op4_suffix_dedup, suffix_array

DOCS = "doc_id long, text string"


def brute(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by a table of all windows."""
    first = {}
    keyed = [((-(1 << 63) if d is None else d), d, (t or "").encode()) for d, t in rows]
    for k, _, b in keyed:
        for i in range(len(b) - WINDOW + 1):
            w = b[i : i + WINDOW]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, d, b in keyed:
        gone = bytearray(len(b))
        for i in range(len(b) - WINDOW + 1):
            if first[b[i : i + WINDOW]] < k:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("text", [b"mississippi", b"a" * 300, b"abab" * 50 + b"ab", bytes(random.Random(3).choices(b"ab", k=700)), bytes(random.Random(4).choices(range(1, 200), k=30_000)), b"ab" * 20_000, b"z"])
def test_suffix_array_is_the_sorted_order(text):
    s = np.append(np.frombuffer(text, np.uint8).astype(np.int64), 0)
    whole = text + b"\0"
    if len(text) > 35_000:
        order = suffix_array(s, 256)
        rank = np.argsort(order)
        a, b = order[:-1], order[1:]  # each is below the next by its first letter, then by the rank of the rest
        assert sorted(order.tolist()) == list(range(len(s)))
        assert all(s[x] < s[y] or s[x] == s[y] and rank[x + 1] < rank[y + 1] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    else:
        assert suffix_array(s, 256).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])


def test_lowest_holders_match_a_table_of_windows():
    rng = random.Random(5)
    base = bytes(rng.choices(b"abcd ", k=400))
    pieces = [base[i : i + n] for i, n in ((rng.randrange(300), rng.randrange(45, 100)) for _ in range(200))]
    low = np.array([rng.randrange(1000) for _ in pieces])
    want = {}
    for p, x in zip(pieces, low.tolist(), strict=True):
        for i in range(len(p) - WINDOW + 1):
            want[p[i : i + WINDOW]] = min(want.get(p[i : i + WINDOW], x), x)
    lows, n = lowest_holders(pieces, low)
    assert lows.tolist() == [want[p[i : i + WINDOW]] for p in pieces for i in range(len(p) - WINDOW + 1)]
    assert n.tolist() == [max(0, len(p) - WINDOW + 1) for p in pieces]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    common = bytes(rng.choices(b"abcdefgh ", k=200))
    data = np.frombuffer(bytes(rng.choices(b"abcdefgh ", k=333)) + common + bytes(rng.choices(b"abcdefgh ", k=77)) + common, np.uint8)
    starts, ends, anchor = anchored(data, np.array([0, len(data)]))
    by_window = {}
    for a, b, m in zip(starts.tolist(), ends.tolist(), anchor.tolist(), strict=True):
        for i in range(a, b - WINDOW + 1):
            assert by_window.setdefault(data[i : i + WINDOW].tobytes(), m) == m
    assert sum(b - a - WINDOW + 1 for a, b in zip(starts.tolist(), ends.tolist(), strict=True)) == len(data) - WINDOW + 1


@pytest.mark.parametrize("hot", [20_000, 3])
def test_documents_match_brute_force(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = result(dedup_substrings(docs, hot=hot, shard_bytes=20_000))
    assert got == want
    assert any(r[2] for r in got)


def test_odd_rows(spark):
    x, y = "é" * 10 + "the quick brown fox jumps over the lazy dog and runs far away", "0123456789" * 8
    rows = [(5, x), (5, x), (3, x + y), (None, y), (7, None), (8, ""), (9, "a" * 500), (10, "a" * 49), (11, "a" * 80), (12, "q" * 200 + y)]
    docs = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows], "doc_id long, text string, k string, row int, found int")
    assert result(dedup_substrings(docs)) == brute(rows)
    assert {r["kept"] for r in dedup_substrings(docs, with_text=True).filter("doc_id = 12").collect()} == {"q" * 200}
    assert dedup_substrings(docs.limit(0)).count() == 0


def test_query_columns(spark, sf):
    assert op4_suffix_dedup(spark, sf).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_copies_and_texts_of_one_letter(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh ", k=600))
    rows = [(d, base) for d in range(40, 90)] + [(d, base[:300] + f"own {d}" + base[300:]) for d in range(30, 45)] + [(d, "z" * (200 + d % 3)) for d in range(20)] + [(d, "short") for d in range(100, 120)]
    rows += [(d, f"own {d} words " + "Eronan " * (60 + d % 7) + "and more") for d in range(200, 230)] + [(199, "Eronan " * 9 + "Eron"), (231, "x" + "Eronan " * 20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for hot in (20_000, 5):
        assert result(dedup_substrings(docs, hot=hot)) == brute(rows)
