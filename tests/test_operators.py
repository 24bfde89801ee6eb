import datetime as d
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import candles, cross, features, fundamentals, lines, portfolio, report
from barloom.sources.config import fund_weights, parse_config, sector_table, weights_table, with_indexes
from barloom.streaming.bars import batch_bars, stream_bars, write_bars
from tests.test_series import bars, values


def test_candle_shapes(spark):
    rows = [("a", d.date(2024, 1, 1) + d.timedelta(k), 10.0 + k * 0.01, 11.0, 9.0, 10.0, 1.0) for k in range(40)]
    rows += [("a", d.date(2024, 3, 1), 10.0, 10.1, 7.9, 8.0, 1.0), ("a", d.date(2024, 3, 2), 7.8, 10.6, 7.7, 10.5, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, volume double")
    from barloom.sources.bars import numbered

    b = numbered(df.withColumn("adj_close", F.col("close")))
    assert [(r["i"], r["style"]) for r in candles.pattern(b, "engulfing").collect()] == [(41, "+")]
    assert len(candles.PATTERNS) == 36
    assert {r["pattern"] for r in candles.all_patterns(b).filter("i = 41").collect()} >= {"engulfing"}
    assert candles.candle_signals(b).filter("i = 41 and value = 'engulfing: +'").collect()[0]["type"] == "bullish"


def test_beta_of_a_scaled_market_is_the_scale(spark):
    x = [100.0]
    for k in range(80):
        x.append(x[-1] * (1 + 0.01 * ((k * 7) % 5 - 2)))
    y = [100.0]
    for a, b in zip(x, x[1:], strict=False):
        y.append(y[-1] * (1 + 2 * (b / a - 1)))
    row = cross.beta(bars(spark, y), bars(spark, x, "^MKT")).collect()[0]
    assert (row["beta"], row["r_squared"]) == (pytest.approx(2.0), pytest.approx(1.0))
    assert cross.rolling_r_squared(bars(spark, y), bars(spark, x, "^MKT"), 20).agg(F.max("r_squared")).first()[0] == pytest.approx(1.0)
    assert set(values(cross.normalized_ratio(bars(spark, x), bars(spark, x, "^MKT")), "ratio")) == {0.0}


def test_index_of_one_symbol_follows_it(spark):
    b = bars(spark, [10.0, 11.0, 12.1, 6.05])
    got = cross.weighted_index(b, weights_table(spark, {"one": {"a": 1.0}})).orderBy("dt").collect()
    assert [r["value"] for r in got] == pytest.approx([25.0, 27.5, 30.25, 15.125])
    spec = '{"Funds": [{"ticker": "F", "makeup": [{"symbol": "a", "allocation": 0.5}, {"symbol": "xCASHx", "allocation": 0.5}]}]}'
    fund = portfolio.synthetic_fund(b, fund_weights(spark, spec)).orderBy("dt").collect()
    assert fund[1]["value"] / fund[0]["value"] == pytest.approx(1.05 + 0.5 * 0.01 / 4 / 2)


def test_ledger(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text("My fund,,\n,,\nStart Capital,1000000\nTicker,MINE\n,,\nStock,Action,Price of Action,Date,Actual Amt,Shares,,Cash Available\na,Buy,10,1/1/2024,1000,100,,\na,Sell,12,1/3/2024,600,50,,\n_cash,Deposit,,1/2/2024,500,,,\n")
    trades, head = portfolio.read_ledger(spark, str(path))
    assert head == {"title": "My fund", "start_capital": "1000000", "ticker": "MINE"}
    b = bars(spark, [10.0, 11.0, 12.0, 13.0])
    got = portfolio.ledger_simulation(trades, b).orderBy("dt").collect()
    assert [(r["value"], r["cash"]) for r in got] == [(1000.0, 999000.0), (1100.0, 999500.0), (600.0, 1000100.0), (650.0, 1000100.0)]
    assert [(r["symbol"], r["shares"], r["percent"]) for r in portfolio.holdings(trades, b).collect()] == [("a", 50.0, 100.0)]


def test_buy_and_hold_reinvests(spark):
    b = bars(spark, [30.0, 40.0, 50.0])
    div = spark.createDataFrame([("a", d.date(2024, 1, 2), 4.0)], "symbol string, dt date, dividend double")
    row = portfolio.buy_and_hold(b, div, 1000.0).collect()[0]
    assert (row["init_shares"], row["cash"], row["final_shares"], row["final_amount"]) == (33.0, 10.0, 36.3, 1825.0)


def test_retirement_and_taxes(spark):
    tax = portfolio.income_tax(spark.createDataFrame([(0.0,), (11000.0,), (50000.0,)], "income double")).orderBy("income").collect()
    assert [r["tax"] for r in tax] == pytest.approx([0.0, 1100.0, 1100 + 33725 * 0.12 + 5275 * 0.22])
    out = portfolio.retirement(portfolio.scenario_grid(spark))
    assert out.count() == 9 * (43 + 7 + 29)
    assert out.filter("roth < 0 or trad < 0 or brokerage < 0").count() == 0
    race = portfolio.contribution_race(spark.createDataFrame([(1, 0.0, 1200.0)], "scenario long, rate double, contribution double")).filter("month = 504").collect()[0]
    assert (race["early"], race["late"]) == (12000.0, 38400.0)
    held = portfolio.race_over(bars(spark, [10.0, 20.0, 40.0]), 2, 100.0).first()
    assert (held["n_rows"], held["early"], held["late"]) == (3, 600.0, 100.0)


def test_scenarios_are_worked_out_together_and_spread(spark):
    shape = "scenario long, contribution double, growth_high double, growth_low double, withdrawal double, years_worked int, roth_share double"
    rows = [(k, 1000.0 * (k % 7), 0.05 + k % 9 / 100, 0.03, 10_000.0 * (k % 4), 1 + k % 60, k % 11 / 10) for k in range(300)] + [(None, None, 0.09, 0.05, 60_000.0, 43, 0.5)]
    # one partition, as a small file gives: without spreading, one task would make all rows
    out = portfolio.retirement(spark.createDataFrame(rows, shape).coalesce(1))
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert len(got) == sum(y + max(0, 50 - y) + 29 for *_, y, _ in rows)
    for s in rows[:300:13]:
        mine = sorted((r for r in got if r["scenario"] == s[0]), key=lambda r: r["year"])
        assert [r["year"] for r in mine] == list(range(len(mine)))
        assert [r["phase"] for r in mine].count("work") == s[5] and mine[-1]["phase"] == "rmd"
        roth = trad = 0.0
        for y, r in enumerate(mine[: s[5]]):
            rate = (s[2] - s[3]) / (1 + math.exp((y - s[5] * 0.6) / 5)) + s[3]
            roth, trad = (roth + s[1] * s[6]) * (1 + rate), (trad + s[1] * (1 - s[6])) * (1 + rate)
            assert (r["roth"], r["trad"], r["savings"]) == pytest.approx((roth, trad, roth + trad))
    assert all(r["roth"] is None for r in got if r["scenario"] is None)


def test_fundamentals(spark):
    items = {"Total Assets": 100.0, "Current Assets": 50.0, "Current Liabilities": 25.0, "Retained Earnings": 50.0, "EBIT": 20.0, "Total Revenue": 80.0}
    s = spark.createDataFrame([("a", "balance", d.date(2020, 1, 1), k, v) for k, v in items.items()], "symbol string, statement string, dt date, item string, value double")
    z = fundamentals.altman_z(s, spark.createDataFrame([("a", 100.0)], "symbol string, market_cap double")).collect()[0]
    assert (z["z"], z["colour"]) == (pytest.approx(1.2 * 0.02 + 0.7 + 0.66 + 2.4 + 0.8), "green")
    g = [("a", d.date(2020, 1, 1), "x", "Buy"), ("a", d.date(2020, 6, 1), "y", "Sell"), ("a", d.date(2022, 2, 1), "y", "Hold"), ("a", d.date(2020, 7, 1), "x", "Strange")]
    got = fundamentals.recommendation_curve(spark.createDataFrame(g, "symbol string, dt date, firm string, grade string")).orderBy("dt").collect()
    assert [(r["firms"], r["mean_grade"]) for r in got] == [(1, 1.0), (2, 2.5), (2, 3.5), (2, 2.5)]


def test_earnings_per_share_are_rounded_once(spark, tmp_path):
    from barloom.plans.queries import QUERIES

    e = spark.createDataFrame([("7", "2001", 44.9996), ("8", "2001", 16.5)], "symbol string, period string, earnings double")
    shares = spark.createDataFrame([("7", 10.0), ("8", 0.0)], "symbol string, shares double")
    assert [r["eps"] for r in fundamentals.earnings_per_share(e, shares).orderBy("symbol").collect()] == [4.5, None]
    assert [r["eps"] for r in fundamentals.earnings_per_share(e, shares, None).orderBy("symbol").collect()] == [4.49996, None]
    # 418.47 over 93 shares is 4.49968: three digits first would make it 4.5, and 5 in the end
    spark.createDataFrame([(90, d.datetime(2001, 5, 1), 418.47)], "o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(90,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    assert QUERIES["eps"](spark, str(tmp_path)).first()["eps"] == 4.0


def test_reports(spark, tmp_path):
    b = bars(spark, [float(k) for k in range(30)])
    series = report.long_series(b, "price", "open", "close")
    row = report.synopsis(series, {"price": "trend"}).filter("component = 'close'").collect()[0]
    assert (row["current"], row["previous"], row["kind"]) == (29.0, 28.0, "trend")
    assert report.export_filter(series, "A nothing").count() == 60
    report.write_csv(report.export_pivot(series, ["price-close"]), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 30


def test_features(spark):
    x = [10, 12, 14, 12, 11, 14, 17, 20, 16, 12, 13, 14, 13, 9, 8, 7] * 6
    b = bars(spark, [float(v) for v in x])
    assert features.filtered_extrema(b, "close").filter("kind = 'max' and i < 16").count() == 3
    assert features.turning_points(b).filter("timeframe = 13").count() == 2 * 8
    assert features.support_resistance(b).filter("rank > 7").count() == 0
    found = lines.trend_lines(b, windows=(27,))
    assert found.filter("end_i < start_i").count() == 0
    assert lines.line_touches(found, b).count() >= 0
    gaps = features.price_gaps(bars(spark, [10.0, 20.0, 10.0])).orderBy("i").collect()
    assert [(r["direction"], r["difference"]) for r in gaps] == [("up", 10.0), ("down", -10.0)]


def test_sectors(spark):
    sectors = sector_table(spark, {"Technology": "T", "Energy": "E"}, {"T": ["a", "b", "c"]})
    assigned = spark.createDataFrame([("a", "technology"), ("z", "Energy"), ("y", "none")], "symbol string, sector string")
    got = {r["symbol"]: (r["etf"], r["peers"]) for r in cross.sector_funds(assigned, sectors).collect()}
    assert got == {"a": ("T", ["b", "c"]), "z": ("E", [])}
    both = bars(spark, [10.0, 20.0, 30.0]).unionByName(bars(spark, [10.0, 10.0, 15.0], "T"))
    ratios = cross.sector_strength(both, cross.sector_funds(assigned, sectors)).orderBy("i").collect()
    assert [(r["kind"], r["fund"], r["ratio"]) for r in ratios] == [("sector", "T", 0.0), ("sector", "T", 1.0), ("sector", "T", 1.0)]
    line = cross.beta_lists(bars(spark, [10.0, 12.0, 9.0, 9.9]), bars(spark, [10.0, 11.0, 9.625, 10.10625], "m")).first()
    assert line["beta"] == pytest.approx(2.0) and line["r_squared"] == pytest.approx(1.0)


def test_config():
    c = parse_config('{"Properties": {"Period": ["2y", "5y"], "Interval": ["1w"], "Indexes": {"mci": true}}, "Exports": {"run": true, "fields": "vti rsi"}, "Ticker Symbols": ["vti"]}')
    assert (c.symbols, c.intervals, c.export) == (["VTI"], ["1wk", "1d"], "vti rsi")
    assert with_indexes(["A"]) == ["A", "^GSPC", "^IRX"]


def test_a_stream_gives_the_bars_of_a_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_bars(stream_bars(stream, late="60 days"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = {(r["symbol"], r["dt"]): r for r in batch_bars(events).collect()}
    out = spark.read.parquet(str(tmp_path / "out")).withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    assert all(tuple(batch[r["symbol"], r["dt"]]) == tuple(r) for r in out.collect())
    table = stream_bars(stream, late="60 days").writeStream.format("memory").queryName("bars").outputMode("complete").start()
    table.processAllAvailable()
    assert spark.table("bars").count() == len(batch)
    table.stop()
