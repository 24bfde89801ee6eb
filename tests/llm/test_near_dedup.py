import random
import re

import numpy as np
import pytest

from barloom.llm.near_dedup import near_duplicates, op2_minhash_near_dedup


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent=80):
    """doc_id, n_shingles, component_id, kept over all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        sets[d] = shingle_set(t, k)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    seen = set()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * len(sets[a] | sets[b]):
                        ra, rb = find(a), find(b)
                        parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_query_matches_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = result(op2_minhash_near_dedup(spark, sf))
    assert got == brute(rows, 4)
    assert any(not r[3] for r in got)


@pytest.mark.parametrize("k", [4, 5])
def test_planted_copies(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (3, 4, 5, 40, 200, 900):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 2, 4, 8, 20, 60):
                words = list(base)
                for _ in range(min(edits, size // 2)):
                    words[rng.randrange(size)] = rng.choice(vocabulary)
                rows.append((n, " ".join(words) if n % 3 else "\t".join(words).upper()))
                n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, got = brute(rows, k), result(near_duplicates(docs, k=k))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (7, "x " * 50_000), (8, "x " * 49_999 + "x")]
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, halves string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, k=4).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (3, 6, True), None: (3, None, True), 7: (1, 7, True), 8: (1, 7, False)}
    assert near_duplicates(docs.limit(0)).count() == 0
    assert np.all(near_duplicates(docs, k=4).count() == len(rows))


def groups_around(rng, size, n, edits):
    """n documents, each the same text with edits of its own."""
    base = [f"w{rng.randrange(9000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(size), rng.choice(edits)):
            words[i] = f"w{rng.randrange(9000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("edits", [(2, 3, 5), (6, 8, 10, 12), (4, 6, 8, 16)])
def test_large_groups_lose_no_link(spark, edits):
    """Near copies, copies just below the threshold, and both: every component is found."""
    rng = random.Random(sum(edits))
    texts = groups_around(rng, 150, 300, edits) + groups_around(rng, 60, 100, [e // 2 for e in edits])
    pool = [f"line {i} of {rng.randrange(9)} common ones" for i in range(40)]
    texts += [" ".join(sorted(rng.sample(pool, 32))) for _ in range(120)]  # parts of one whole, with nothing of their own
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_duplicates(docs, k=4)) == brute(rows, 4)


def test_rows_of_one_document_with_different_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (3, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for parts in (1, 3):
        got = result(near_duplicates(docs.repartition(parts), k=4))
        assert [r[0] for r in got] == [1, 1, 2, 3]
        want = want or got
        assert got == want
