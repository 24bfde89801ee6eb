"""Runs of one sign, sessions of signals, levels and reversals on small series; tests.test_oracles holds their queries against SQL."""

import datetime as d

import pytest

from barloom.operators import candles, features, oscillators, report
from tests.test_series import bars

SIGNALS = "symbol string, i long, dt date, type string, value string, score double, indicator string"


def series(spark, x):
    return bars(spark, [1.0] * len(x)).join(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, x double"), "i")


def test_runs_go_over_zeros(spark):
    got = oscillators.sign_runs(series(spark, [0, 1, 0, 2, -1, 0, -2, 3]), "x").orderBy("i").collect()
    assert [(r["run_start"], r["run_end"]) for r in got] == [(0, 0), (0, 3), (2, 2), (0, 3), (4, 6), (4, 6), (4, 6), (7, 7)]


def test_factor_of_runs(spark):
    x = [100 + 8 * ((k // 11) % 2) + 0.1 * k for k in range(120)]
    got = {r["i"]: r for r in oscillators.macd_runs(bars(spark, x)).collect()}
    assert got[1]["factor"] == 1.25
    for i in range(40, 120):
        run = got[i - 2]
        earlier = got[run["run_start"] - 2]
        assert got[i]["factor"] == pytest.approx(1.5 - run["run_rows"] / max(run["run_rows"], earlier["run_rows"]) * 0.5)


def test_statistics_of_short_and_flat_series(spark):
    for x in ([5.0], [5.0] * 4, [5.0] * 60):
        r = oscillators.macd_statistics(bars(spark, x)).first()
        assert r["state"] in ("weakly_bearish", "weakly_bullish") or r["macd"] is None
    up = oscillators.macd_statistics(bars(spark, [float(k * k) for k in range(60)])).first()
    assert (up["current_trend"], up["group_trend"]) == ("rising", "rising") and up["group_value"] == pytest.approx(100.0)
    down = bars(spark, [1000.0 - k * k for k in range(60)])
    assert oscillators.macd_statistics(down).first()["group_trend"] == "falling"
    assert oscillators.macd_statistics(down, compat=True).first()["group_trend"] is None


def test_sessions_of_signals(spark):
    day = lambda k: d.date(2020, 1, 1) + d.timedelta(k)
    rows = [("a", k, day(k), t, "v", 1.0, n) for k, t, n in [(0, "bullish", "x"), (5, "bullish", "y"), (15, "bullish", "x"), (26, "bullish", "x"), (3, "bearish", "x")]]
    got = report.merged_signals(spark.createDataFrame(rows, SIGNALS), "10 days").orderBy("type", "first_i").collect()
    assert [(r["type"], r["first_i"], r["last_i"], r["n_signals"], r["indicators"]) for r in got] == [("bearish", 3, 3, 1, "x"), ("bullish", 0, 15, 3, "x,y"), ("bullish", 26, 26, 1, "x")]
    assert report.merged_signals(spark.createDataFrame([], SIGNALS)).count() == 0


def levels(spark, *rows):
    return spark.createDataFrame([("a", float(p), s) for p, s in rows], "symbol string, price double, start long")


def test_levels_unite_round_by_round(spark):
    got = features.united_levels(levels(spark, (100, 5), (100.5, 2), (101, 9), (150, 1))).orderBy("price").collect()
    assert [(r["price"], r["start"]) for r in got] == [(100.5, 2), (150.0, 1)]  # 100.25 and 100.75, then their mean
    assert [r["price"] for r in features.united_levels(levels(spark, (100, 5))).collect()] == [100.0]
    assert [r["price"] for r in features.united_levels(levels(spark, (10.01, 0), (10.02, 0))).collect()] == [10.02]  # half a cent to the even one


def test_analysis_of_levels(spark):
    b = bars(spark, [90.0, 100.0])
    held = levels(spark, *[(50 + 4 * k, k) for k in range(25)])
    got = features.level_analysis(held, b).collect()
    near = {n: [r["price"] for r in sorted((r for r in got if r["list"] == n), key=lambda r: r["rank"])] for n in ("support", "resistance", "major")}
    assert near["support"] == [98, 94, 90, 86, 82, 78, 74] and near["resistance"] == [102, 106, 110, 114, 118, 122, 126] and near["major"][:2] == [146, 142] and len(near["major"]) == 25
    assert {r["state"] for r in got if r["list"] == "support"} == {"support"}


def test_nearest_levels(spark):
    b = bars(spark, [10.0, 20.0, 15.0, 30.0])
    got = {r["i"]: (r["support"], r["resistance"]) for r in features.nearest_levels(levels(spark, (12, 0), (20, 0), (25, 0)), b).collect()}
    assert got == {0: (None, 12.0), 1: (20.0, 25.0), 2: (12.0, 20.0), 3: (25.0, None)}
    assert features.nearest_levels(levels(spark, (1, 0)).limit(0), b).filter("support is null and resistance is null").count() == 4


def test_reversals_are_confirmed_by_the_oscillator(spark, sf):
    from barloom.plans.queries import QUERIES
    from barloom.plans.candle_rows import line_candles

    every = {(r["symbol"], r["i"]): r["value"] for r in QUERIES["candle_reversals_unconfirmed"](spark, sf).collect()}
    kept = {(r["symbol"], r["i"]): r["value"] for r in QUERIES["candle_reversals"](spark, sf).collect()}
    assert 0 < len(kept) < len(every) and all(v == 2 * every[k] for k, v in kept.items())
    assert candles.reversal_patterns(line_candles(spark, sf), compat=True).count() == 0
