import hashlib

import pytest
import regex

from barloom.llm.pii import estimate, find_personal_data, op1_personal_data, train_classifier

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, found):
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in regex.finditer(PATTERNS[k], text or "") if valid(k, m[0])]


ODD = [
    "", None, "@", "a@b", "a@b.c", "a@@b.c.d x.y@z.co.", "..a@b-.c", "a@b.c@d.e", "x@y.z-", "1.2.3.4", "256.1.1.1 1.2.3.4.5.6.7.8", "001.02.003.0255", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111",
    "4111 1111 1111 11112", "00000000000000000000", "+1 (555) 010-9999", "+12345678", "+1234567", "++49 30 1234567 8", "+1-", "😀 é a@b.cd +49 (30) 12345678. 10.0.0.1", "1.1.1.1.1.1.1", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a@b." + "c" * 3000 + " 9" * 5000,
]


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_spans_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, base string")
    got = rows_of(find_personal_data(docs))
    for i, t in enumerate(ODD):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["base"]] == brute(t), t
    assert find_personal_data(docs.limit(0)).count() == 0


def test_query_matches_the_patterns(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = 0
    for d, r in rows_of(op1_personal_data(spark, sf)).items():
        want = brute(texts[d])
        found += len(want)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert r["spans"].startswith(joined)
    assert found


def test_labelers_add_spans(spark):
    texts = [f"Contact us: call {n}" for n in ("(415) 555-2671", "212-555-0199", "312 555 0147")] * 5 + ["version 123-45-6789 order", "my ssn is 123-45-6788 ok", "write to jane (at) example (dot) org today", "clean words only 12 34"] * 3
    got = rows_of(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert all(any(s["kind"] == "phone_local" for s in got[i]["extra"]) for i in range(15))
    assert any(s["kind"] == "email_spelled" for s in got[17]["extra"])
    assert got[18]["extra"] == []


def test_reliabilities_follow_agreement():
    patterns = [("k", (1, 1, 1, 1), 50), ("k", (-1, -1, 0, -1), 50), ("k", (1, -1, 0, 1), 5)]
    post = estimate(patterns)
    assert post["k", (1, 1, 1, 1)] > 0.95 > 0.05 > post["k", (-1, -1, 0, -1)]
    w = train_classifier([(k, v, (), n) for k, v, n in patterns], post)["k"]
    assert sum(w) > 0 and w[0] - w[1] - w[2] - w[4] < 0
    assert estimate([]) == {} and train_classifier([], {}) == {}
    assert post == pytest.approx(estimate(patterns))


def test_candidates_of_any_length_are_whole(spark):
    from pyspark.sql import functions as F

    from barloom.llm.pii import CANDIDATES, spans_of

    found = {"secret": "token=" + "aB3/" * 500, "email_spelled": "ab.c" * 50 + " (at) example (dot) com"}
    for kind, text in found.items():
        docs = spark.createDataFrame([(f"see {text}; {text}",), ("x" * 200_000,)], "text string")
        got = [[(x["start"], x["end"]) for x in r["s"]] for r in docs.select(F.expr(spans_of("text", CANDIDATES[kind]["find"])).alias("s")).collect()]
        assert got == [[(4, 4 + len(text)), (6 + len(text), 6 + 2 * len(text))], []]


def test_classifier_sees_the_span():
    """Votes that say nothing leave the shape to decide, by what other spans of that shape are."""
    sure, lost, unsure = (1, 1, 1, 1), (-1, -1, -1, -1), (1, 0, 0, -1)
    rows = [("k", sure, (5, 4), 100), ("k", lost, (2, 0), 100), ("k", unsure, (5, 4), 30), ("k", unsure, (2, 0), 30)]
    post = {("k", sure): 1.0, ("k", lost): 0.0, ("k", unsure): 0.5}
    w = train_classifier(rows, post, steps=3000)["k"]
    score = lambda v, shape: w[0] + sum(a * b for a, b in zip(w[1:], (*v, *(x / 8 for x in shape)), strict=True))
    assert score(unsure, (5, 4)) > 0 > score(unsure, (2, 0))


def test_planted_secrets_are_found_and_clean_texts_left(spark):
    rows = [(i, f"words before token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and after") for i in range(40)]
    rows += [(i, f"export API_KEY=AKIAQXZTQXZT{i:04d} now") for i in range(40, 50)] + [(i, f"the token of page {i} is a word, key: none") for i in range(50, 150)]
    got = rows_of(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all([s["kind"] for s in got[i]["extra"]] == ["secret"] for i in range(50))
    assert all(not got[i]["extra"] and not got[i]["base"] for i in range(50, 150))
