"""Ledger and configuration formats, and calendars."""

import datetime as d

import pytest

from barloom.sources import files
from barloom.sources.bars import calendar_of, inserted
from tests.test_series import bars


def trades(spark):
    rows = [("A", "Fund, the first", 1e6, "x", "Buy", 10.5, d.date(2024, 1, 3), 105.0, 10.0), ("A", "Fund, the first", 1e6, "y", "Sell", 2.0, d.date(2024, 1, 2), 4.0, 2.0), ("B/é", 'with "quotes"', 5.0, "_cash", "Deposit", None, d.date(2023, 12, 31), 7.0, None)]
    return spark.createDataFrame(rows, files.LEDGER)


def test_ledgers_come_back_as_they_went(spark, tmp_path):
    files.write_ledgers(trades(spark), str(tmp_path / "l"))
    back = spark.read.format("ledger").load(str(tmp_path / "l"))
    assert sorted(map(str, back.collect())) == sorted(map(str, trades(spark).collect()))
    names = [p.name for p in (tmp_path / "l").iterdir()]
    assert len(names) == 2 and not any(n.startswith("_") for n in names)
    one = next(str(p) for p in (tmp_path / "l").iterdir() if p.name.startswith("A-"))
    assert files.read_head(one) == {"title": "Fund, the first", "start_capital": "1000000.0", "ticker": "A"}
    files.write_ledgers(trades(spark).limit(0), str(tmp_path / "none"))


def test_a_large_ledger_is_spread_over_tasks(spark, tmp_path):
    rows = [(t, f"Fund, {t}", 1e6, f"P{k % 5}", "Buy", None if k % 97 == 0 else k / 8, d.date(1992 + k % 7, 1 + k % 12, 1 + k % 28), k * 1e5, 1.0 + k % 3) for t in ("A", "B") for k in range(11_000)]
    made = spark.createDataFrame(rows, files.LEDGER)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # so little would be one task's again
    spark.conf.set(merge, False)
    try:
        files.write_ledgers(made, str(tmp_path / "l"), by_year=True)
    finally:
        spark.conf.unset(merge)
    back = spark.read.format("ledger").load(str(tmp_path / "l"))
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    names = [p.name for p in (tmp_path / "l").iterdir()]
    assert len(names) > 2 and {n[0] for n in names} == {"A", "B"}
    files.write_ledgers(made, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").iterdir())) == 2
    first = next(str(p) for p in (tmp_path / "one").iterdir() if p.name.startswith("A-"))
    # read in batches, as written: head, then rows by date with numbers as Python shows them
    assert [type(b).__name__ for b in files.LedgerReader(first).read(files.FilePartition(first))] == ["RecordBatch"] * 2
    lines = open(first).read().splitlines()
    assert lines[0] == '"Fund, A",,,,,,,' and lines[2] == "Start Capital,1000000.0,,,,,," and lines[6].split(",")[1:4:2] == ["Buy", "1/1/1992"]


def test_odd_ledgers(spark, tmp_path):
    files.register(spark)
    (tmp_path / "a.csv").write_text("Mine\r\n,,\r\nTicker,\r\nStock,Action\r\n,,,,0\r\nz,Buy,$1 000,2/30/2024,1\r\nz,Buy,$1 000,2/3/2024\r\n")
    got = spark.read.format("ledger").load(f"file://{tmp_path}").collect()
    assert [(r["ticker"], r["title"], r["stock"], r["price"], r["dt"], r["shares"]) for r in got] == [("a", "Mine", "z", 1000.0, d.date(2024, 2, 3), None)]
    (tmp_path / "b.csv").write_text("no head\n" * 3)
    with pytest.raises(Exception, match="no row begins with Stock"):
        spark.read.format("ledger").load(str(tmp_path / "b.csv")).collect()


def test_configurations(spark, tmp_path):
    files.register(spark)
    (tmp_path / "one.json").write_text('{\n"Properties": {"Period": ["2y", "1y"], "Interval": ["1w"], "Indexes": {"mci": true, "bci": false}},\n"Ticker Symbols": ["vti", "b "]}')
    (tmp_path / "lines.txt").write_text('{"Ticker Symbols": "x y"}\n\n{"Ticker Symbols": []}\n')
    got = sorted((r["file"], r["symbol"], r["period"], r["months"], r["interval"], tuple(r["indexes"])) for r in spark.read.format("run_config").load(str(tmp_path)).collect())
    assert got == [("lines.txt", "X", "2y", 24, "1d", ()), ("lines.txt", "Y", "2y", 24, "1d", ())] + [("one.json", s, p, m, i, ("mci",)) for s in ("B", "VTI") for p, m, i in (("1y", 12, "1d"), ("2y", 24, "1wk"))]


def test_missing_dates_are_inserted_in_order(spark):
    b = bars(spark, [10.0, 11.0, 12.0, 13.0, 14.0])
    calendar = calendar_of(b, "1 day")
    assert calendar.count() == 5
    got = inserted(b.filter("i not in (0, 2, 3)"), calendar).orderBy("i").collect()
    assert [(r["symbol"], r["i"], r["dt"].day) for r in got] == [("a", 0, 1), ("a", 2, 3), ("a", 3, 4)]
    assert inserted(b, calendar).count() == 0 and calendar_of(b.limit(0)).count() == 0
