"""Source divergences against plain arithmetic; the query is compared with SQL too."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from barloom.llm import divergence as dv
from barloom.llm.common import utf8


def plain(docs, least=30):
    held, groups = defaultdict(Counter), set()
    df = defaultdict(Counter)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        held[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        own = {s: share(held[lang, s]) for g, s in groups if g == lang}
        both = share(sum((held[lang, s] for s in own), Counter()))
        for s, p in own.items():
            pairs = sorted((-sum(abs(p[t] - q[t]) for t in kept), o.encode()) for o, q in own.items() if o != s)
            terms = sorted((both[t] - p[t], t.encode()) for t in kept if held[lang, s][t] and p[t] > both[t])[:50]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, rows in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(rows)}
    return out


def test_against_plain_arithmetic(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)] + ["Ünder", "ünder", "É", "日本語", "CAPS", "caps"]
    docs = [(" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 60))) + rng.choice([".", "1x2", "_a-b", "\t"]), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None, "é"])) for _ in range(900)]
    docs += [(None, "en", "a"), ("", "en", "empty"), ("... 123", "xx", "numbers"), ("alone", "yy", "one"), ("other", "yy", "two"), ("w " * 20_000, "en", "long")] + [docs[0]] * 40
    df = spark.createDataFrame([(*d, "x", 1, "t") for d in docs], "text string, lang string, source string, term string, n int, part string").repartition(4)
    got = {tuple(r) for r in dv.divergences(df).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(docs) and {p for _, _, p, *_ in got} == {"pair", "term"}
    assert dv.divergences(df.limit(0)).count() == 0


def test_equal_hashes_are_told_apart_by_their_bytes():
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "bb", "ab", "ba", "ccc", "é", "ab"]) for _ in range(500))
    data, offsets = utf8(pa.array([text]))
    starts, ends, _ = dv.term_spans(data, offsets)
    for weak in (lambda b: 7, len, lambda b: b[0], dv.xxhash.xxh3_64_intdigest):
        code, terms = dv.grouped(data, starts, ends, weak)
        assert len(set(terms)) == len(terms) == 6
        assert [terms[c].decode() for c in code.tolist()] == text.split()
    code, terms = dv.grouped(*utf8(pa.array([], pa.string()))[:1], np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(code) and terms == []


def test_shares_of_counts_beyond_64_bits():
    counts = np.array([0, 10**12, 3 * 10**12], np.int64)
    assert dv.shares(counts, int(counts.sum()), 3).tolist() == [1 + 10**9 * (int(c) + 5) // (int(counts.sum()) + 15) for c in counts]


def test_spans_end_with_their_row():
    data, offsets = utf8(pa.array(["ab", "cd1e", None, "é_f"]))
    starts, ends, row = dv.term_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "cd", "e", "é", "f"] and row.tolist() == [0, 1, 1, 3, 3]
