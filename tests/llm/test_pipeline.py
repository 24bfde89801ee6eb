import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, sf)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= before and len(kept) > 0.5 * len(before)
        before = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before


def test_odd_documents(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (None, "words in a row", "en", "s", 14), (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf)
            assert table.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, table, sf).count()


def test_clashing_columns_repeated_rows_and_a_long_text(spark, sf):
    long = " ".join(f"word{k} of a long text" for k in range(60_000))
    rows = [(1, "first line here\nsecond line here\nthird one of it"), (2, long), (3, "some other words that stand for themselves\nand a second line"), (3, "some other words that stand for themselves\nand a second line")]
    more = ["n_lines_removed", "score", "kept", "row", "_row", "_id", "_hash", "_lost", "salt", "item_ids", "a.b", "count", "node", "root", "component_id", "n_chars"]
    docs = spark.createDataFrame([(*r, *["x"] * (len(more) - 1), len(r[1])) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in more[:-1]) + ", n_chars long")
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf)
        assert table.columns == docs.columns, name
        got = [tuple(r) for r in table.collect()]
        # nothing here is toxic, contaminated or a copy of another document; equal rows are one after near-dedup
        assert sorted(r[0] for r in got) == ([1, 2, 3, 3] if name in ("toxicity", "line_dedup") else [1, 2, 3]), name
        assert all(r[2:-1] == ("x",) * (len(more) - 1) for r in got), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 3} and all(r["length"] <= 4096 for r in pieces)
