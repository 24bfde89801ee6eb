import random

from barloom.llm.line_dedup import dedup_lines, op8_line_dedup, with_runs


def chunks_of(spark, texts):
    """For each text its lines' numbers where chunks begin and end."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in with_runs(df).collect()}


def test_runs_cover_every_pair_and_shift_with_the_text(spark):
    rng = random.Random(1)
    lines = [rng.choice(["", "  "]) if rng.random() < 0.2 else f"line {rng.randrange(10**6)}" for _ in range(200)]
    texts = ["\n".join(lines), "\n".join(["new", *lines]), "", "one", "\n\n", "a\nb"]
    got = chunks_of(spark, texts)
    for i, t in enumerate(texts):
        own = t.split("\n")
        solid = [k for k, x in enumerate(own) if x.strip()]
        pairs = set(zip(solid, solid[1:]))
        runs = {(r["_at"], r["_to"]) for r in got[i]["_runs"]}
        chunks = [(r["_at"], r["_to"]) for r in got[i]["_runs"] if r["_chunk"]]
        assert pairs <= runs and runs - pairs <= set(chunks)
        assert all(a[1] < b[0] for a, b in zip(sorted(chunks), sorted(chunks)[1:]))
        for r in got[i]["_runs"]:
            inside = [c for c in chunks if c[0] <= r["_at"] and r["_to"] <= c[1]]
            assert r["_in"] in ((inside[0][0],) if inside else (-1, r["_at"]))
    chunks = [{(r["_at"] - i, r["_to"] - i) for r in got[i]["_runs"] if r["_chunk"]} for i in (0, 1)]
    assert len(chunks[0]) > 20 and len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: "\n".join(x) for d, x in all_runs([(d, t or "") for d, t in rows]).items()}
    got = {r["doc_id"]: r for r in dedup_lines(spark.read.parquet(f"{sf}/documents.parquet"), drop_emptied=False).collect()}
    assert {d: r["text"] or "" for d, r in got.items()} == want
    out = {r["doc_id"]: r for r in op8_line_dedup(spark, sf).collect()}
    assert {d: r["n_chars"] for d, r in out.items()} == {d: len(t) for d, t in want.items()}
    assert all((r["n_lines_removed"] > 0) == (want[d] != (dict(rows)[d] or "")) for d, r in out.items())


def test_odd_rows(spark):
    block = "\n".join(f"repeated line number {i} with words" for i in range(30))
    rows = [(1, "a\n" + block), (2, block), (2, block), (3, None), (4, ""), (None, "z"), (5, "\n" * 5000), (6, "x\n" * 3), (6, "x\n" * 3)]
    docs = spark.createDataFrame([(d, t, 9, "k") for d, t in rows], "doc_id long, text string, n_chars long, _x string")
    out = dedup_lines(docs, drop_emptied=False)
    assert out.columns == ["doc_id", "text", "n_chars", "_x", "n_lines_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    assert next(r for r in got if r["doc_id"] == 1)["text"] == "a\n" + block
    assert all(r["n_lines_removed"] > 20 for r in got if r["doc_id"] == 2)
    assert next(r for r in got if r["doc_id"] == 3)["text"] is None
    assert dedup_lines(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in dedup_lines(docs).collect()} >= {1, 3, 4, None, 5, 6}


def all_runs(rows):
    """Lines left of each text: a line goes with a neighbour if both stood together before, and not in an overlapping place."""
    first, left = {}, {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        solid, gone = [i for i, x in enumerate(lines) if x.strip()], set()
        for a, b in zip(solid, solid[1:]):
            at = first.setdefault("\n".join(lines[a : b + 1]), (d, a, b))
            if at[0] != d or at[2] < a:
                gone |= set(range(a, b + 1))
        left[d] = [x for i, x in enumerate(lines) if i not in gone]
    return left


def test_every_repeated_run_of_two_lines_or_more_goes(spark):
    rng = random.Random(3)
    runs = [[f"run {k} line {i}" for i in range(2 + k % 4)] for k in range(40)]
    rows = []
    for d in range(200):
        lines = []
        for n in range(rng.randrange(1, 5)):
            lines += [f"own {d} {n}", *rng.choice(runs), *rng.choice([[], [""], ["", "  "]])]
        rows.append((d, "\n".join(lines)))
    rows += [(300, "x\nx\nx"), (301, "y\n\ny\ny\n\ny"), (302, rows[0][1] + "\n"), (303, "p\nq\np\nq\nr"), (304, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_lines(docs, drop_emptied=False).collect()}
    want = all_runs(rows)
    assert {d: r["text"] for d, r in got.items()} == {d: "\n".join(x) for d, x in want.items()}
    assert all(r["n_lines_removed"] == dict(rows)[d].count("\n") + 1 - len(want[d]) for d, r in got.items())
    assert got[300]["n_lines_removed"] == 0 and got[303]["text"] == "p\nq\nr"
    assert 302 not in {r["doc_id"] for r in dedup_lines(docs).collect()}


def test_columns_of_any_name(spark):
    block = "first line here\nsecond line here\nthird line here"
    docs = spark.createDataFrame([(1, block, -5, "h", [7], "x"), (2, "own\n" + block, -6, "i", [8], None)], "doc_id long, text string, _id long, _hash string, _gone array<int>, `a.b` string")
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert got[2]["text"] == "own" and got[2]["_id"] == -6 and got[2]["_hash"] == "i" and got[2]["_gone"] == [8] and got[1]["a.b"] == "x"
    assert dedup_lines(docs).columns == [*docs.columns, "n_lines_removed"]


def test_the_count_takes_the_place_of_a_column_or_is_left_out(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x"), (2, "a\nb\nd", "y")], "doc_id long, text string, n_lines_removed string")
    counted = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert dedup_lines(docs).columns == docs.columns and (counted[1]["n_lines_removed"], counted[2]["n_lines_removed"]) == (0, 2)
    assert {(r["doc_id"], r["text"], r["n_lines_removed"]) for r in dedup_lines(docs, count=None).collect()} == {(1, "a\nb\nc", "x"), (2, "d", "y")}


def test_one_very_long_text(spark):
    lines = [f"line {i % 4000} of many" for i in range(12_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "y" * 2_000_000), (3, "y" * 2_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: (len(r["text"]), r["n_lines_removed"]) for r in dedup_lines(docs).collect()}
    assert got == {1: (len("\n".join(lines[:4000])), 8000), 2: (2_000_000, 0), 3: (2_000_000, 0)}
