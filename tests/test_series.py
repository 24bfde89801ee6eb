import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.operators import features, lines, oscillators, trend, volatility
from barloom.sources.bars import aligned, from_wide, invalid, numbered, repair, resample


def bars(spark, closes, symbol="a", spread=1.0):
    rows = [(symbol, f"2024-{k // 28 + 1:02d}-{k % 28 + 1:02d}", c, c + spread, c - spread, c, 10.0) for k, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, d string, open double, high double, low double, close double, volume double")
    return numbered(df.withColumn("dt", F.to_date("d")).drop("d").withColumn("adj_close", F.col("close")))


def values(df, name):
    return [r[name] for r in df.orderBy("symbol", "i").select(name).collect()]


def ema_by_hand(x, n):
    out = list(x)
    e = out[n - 1] = sum(x[:n]) / n
    for i in range(n, len(x)):
        e = out[i] = e * (1 - 2 / (n + 1)) + x[i] * 2 / (n + 1)
    return out


def test_averages_on_a_ramp(spark):
    x = [float(k) for k in range(1, 41)]
    b = bars(spark, x)
    assert values(trend.simple_average(b, 5), "sma")[:6] == [1, 2, 3, 4, 3, 4]
    assert values(trend.exponential_average(b, 5), "ema") == pytest.approx(ema_by_hand(x, 5))
    assert values(trend.weighted_average(b, 3), "wma")[3] == pytest.approx((1 * 2 + 2 * 3 + 3 * 4) / 6)
    assert values(trend.auto_trend(b, (4,), (1.0,), normalize=False), "trend")[10] == pytest.approx(1.0)


def test_exponential_averages_hold_one_batch_at_a_time(spark):
    from barloom.operators import candles

    rng = np.random.default_rng(3)
    parts = {"a": 137, "b": 9, "c": 8, "d": 23, "": 5, None: 64}
    x = {k: rng.normal(100, 5, n).tolist() for k, n in parts.items()}
    b = bars(spark, x["a"], "a").limit(0)
    for k in x:
        b = b.unionByName(bars(spark, x[k], k))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows in (1, 7, 10000):
            spark.conf.set(size, rows)
            got = trend.exponential_average(b.repartition(5), 5).collect()
            for k, v in x.items():
                mine = [r["ema"] for r in sorted((r for r in got if r["symbol"] == k), key=lambda r: r["i"])]
                want = s.ema(np.array(v), 5)
                assert mine == ([None] * len(v) if np.isnan(want).all() else want.tolist())
    finally:
        spark.conf.set(size, before)
    # neither averages nor candles gather a symbol's rows in a worker, whose memory would grow with it
    for df in (trend.exponential_average(b, 5), candles.pattern(b, "engulfing")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("n", [36, 37])
def test_short_series_have_no_average(spark, n):
    b = bars(spark, [float(k) for k in range(40)])
    assert [v is None for v in values(trend.simple_average(b, n), "sma")] == [n == 37] * 40
    assert [v is None for v in values(trend.exponential_average(b, n), "ema")] == [n == 37] * 40


def test_flat_series_divide_by_nothing(spark):
    b = bars(spark, [5.0] * 60, spread=0.0)
    assert set(values(oscillators.stochastic(b), "fast_k")) == {50.0}
    assert set(values(oscillators.rsi(b), "rsi")) == {50.0, 100.0}
    assert values(oscillators.momentum(b), "momentum")[30] is None
    assert values(oscillators.commodity_channel(b, (20,)), "cci_20")[30] is None
    assert set(values(volatility.directional_index(b), "di_plus")) == {0.0, None}
    assert oscillators.zero_crossings(oscillators.rate_of_change(b), "roc_10").count() == 0


def test_rows_in_any_order_and_other_symbols_change_nothing(spark):
    rng = np.random.default_rng(1)
    x = (100 + rng.normal(0, 1, 120).cumsum()).tolist()
    one = bars(spark, x)
    two = one.unionByName(bars(spark, x[::-1], "b")).orderBy(F.rand(3)).repartition(3)
    for f, c in ((oscillators.macd, "macd"), (trend.parabolic_sar, "sar_fast"), (oscillators.cluster_oscillators, "clustered"), (volatility.bollinger_metric, "metric")):
        assert values(f(two).filter("symbol = 'a'"), c) == pytest.approx(values(f(one), c), nan_ok=True)


def test_metrics_stay_within_one(spark):
    rng = np.random.default_rng(2)
    b = bars(spark, (100 + rng.normal(0, 2, 260).cumsum()).tolist())
    for f in (oscillators.stochastic_metric, oscillators.rsi_metric, oscillators.ultimate_metric, volatility.bear_bull_metric, volatility.total_power_metric, volatility.demand_metric):
        m = [v for v in values(f(b), "metric") if v is not None]
        assert len(m) == 260 and max(abs(v) for v in m) <= 1 + 1e-9


def turns(fast, slow):
    """Rows where fast takes the other side of slow; equal values keep the side, and the first side counts."""
    out, held = [], 0
    for i, (a, b) in enumerate(zip(fast, slow, strict=True)):
        if a != b and (a > b) != (held > 0) or a != b and held == 0:
            held = 1 if a > b else -1
            out.append((i, "bullish" if held > 0 else "bearish"))
    return out


def test_crossovers_against_a_plain_loop(spark):
    x = [float(40 - k) for k in range(40)] + [float(k) for k in range(40)] + [20.0] * 30
    df = trend.triple_average(bars(spark, x), (3, 5, 10))
    found = trend.crossovers(df, (3, 5, 10)).orderBy("i").collect()
    s, m, g = (values(df, c) for c in trend.LEGS)
    assert [(r["i"], r["type"]) for r in found if "midterm" in r["value"]] == turns(s, m)
    assert [(r["i"], r["type"]) for r in found if "longterm" in r["value"]] == turns(m, g)


def test_stop_and_reverse_turns_once(spark):
    x = [float(60 - k) for k in range(40)] + [float(20 + 2 * k) for k in range(40)]
    found = trend.sar_signals(bars(spark, x)).filter("value like '%fast'").collect()
    assert [r["type"] for r in found] == ["bullish"]


def test_spread_and_zigzag():
    assert [e[:2] for e in oscillators.zigzag([1, 5, 10, 4, 3, 9, 20, 5], 0.5)] == [(2, 10), (4, 3), (6, 20)]
    assert oscillators.bounces([10, 8, 11, 7, 9], 0, 1) == [(7, 3)]  # the row of the low, as the survey has it, not of the bounce
    assert oscillators.bounces([10, 12, 9, 13, 11], 0, -1) == [(13, 3)]


def test_state_machines_by_hand():
    fast, slow = [50, 85, 90, 88, 75], [50, 70, 85, 89, 85]
    assert list(oscillators._zone_crossings(fast, slow, "x")) == [(4, "bearish", "x", -1.0)]
    lo, hi = [30] * 6, [70] * 6
    assert list(oscillators._rejections([25, 40, 35, 36, 41, 50], lo, hi)) == [(4, "bullish", "swing rejection", 1.0)]
    assert [e[:2] for e in oscillators._cci_events([10, 120, 50, -5, -150, 3], 20)] == [(1, "bullish"), (3, "bearish"), (4, "bearish"), (5, "bullish")]
    assert [e[:2] for e in oscillators._leaves_zone([0, 11, 9, -11, -9], 10, -10, "", 1.0)] == [(2, "bearish"), (4, "bullish")]
    assert [e[:2] for e in oscillators._saucers([1, 5, 4, 3, 4])] == [(4, "bullish")]
    assert [e[:2] for e in oscillators._twin_peaks([1, 5, 3, 4, 3.5])] == [(4, "bearish")]


def test_repair_follows_the_order_of_rows(spark):
    nan = float("nan")
    x = [None, 10.0, None, 12.0, nan, nan, nan, 20.0, None]
    b = bars(spark, [1.0] * 9).drop("close").withColumn("close", F.element_at(F.array(*[F.lit(v).cast("double") for v in x]), (F.col("i") + 1).cast("int")))
    assert values(repair(b), "close") == [10.0, 10.0, 11.0, 12.0, 12.0, 12.0, 16.0, 20.0, 20.0]
    assert invalid(b).count() == 0
    assert invalid(b.withColumn("close", F.lit(None).cast("double"))).collect()[0]["n_missing"] == 9


def test_alignment_resampling_and_wide_input(spark):
    b = bars(spark, [float(k) for k in range(56)])
    out = aligned(b.filter("i not in (0, 10, 55)"), b)
    assert values(out, "close")[:1] + values(out, "close")[10:11] + values(out, "close")[55:] == [1.0, 10.0, 54.0]
    month = resample(b, "month").orderBy("dt").collect()
    assert [(r["open"], r["close"], r["high"], r["volume"]) for r in month] == [(0.0, 27.0, 28.0, 280.0), (28.0, 55.0, 56.0, 280.0)]
    wide = b.select("dt", *[F.col(c).alias(f"x_{c}") for c in ("open", "high", "low", "close", "adj_close", "volume")])
    assert from_wide(wide, ["x"]).count() == 56


def test_empty_bars(spark):
    b = bars(spark, [1.0]).limit(0)
    for f in (oscillators.rsi, oscillators.macd, trend.parabolic_sar, volatility.on_balance_volume, oscillators.rsi_signals):
        assert f(b).count() == 0


def test_ema_helper_is_nan_for_short_series():
    assert math.isnan(s.ema(np.arange(5.0), 3)[0])


def test_symbols_without_a_result_row(spark):
    flat = bars(spark, [5.0] * 200, spread=0.0)
    rng = np.random.default_rng(2)
    both = flat.unionByName(bars(spark, (100 + rng.normal(0, 2, 200).cumsum()).tolist(), "b"))
    for make in (
        lambda b: lines.trend_lines(b), lambda b: lines.trend_lines(b, windows=(1000,)), lambda b: features.zigzag_extrema(b, threshold=1e9), lambda b: features.zigzag_extrema(b),
        lambda b: lines.channel_lines(b, (64,)), lambda b: lines.line_forecast(lines.trend_lines(b), b), lambda b: lines.line_touches(lines.trend_lines(b), b), oscillators.ultimate_signals,
        oscillators.rsi_signals, oscillators.macd_signals, volatility.bollinger_signals,
    ):
        make(flat).collect()
        make(both).collect()


def survey_swings(x, c, lo, hi):
    """The second search of the ultimate oscillator, state by state as the survey lists it."""
    state, p, u, out = "n", [0.0, 0.0], [0.0] * 3, []
    for i, v in enumerate(x):
        if state == "n" and v <= lo:
            state, u[0] = "u1", v
        elif state == "u1" and v < u[0]:
            u[0] = v
        elif state == "u1":
            p[0], state = c[i - 1], "u2"
        elif state == "u2" and v > lo:
            state, u[1] = "u3", v
        elif state == "u3" and v > u[1]:
            u[1] = v
        elif state == "u3":
            state, u[2] = "u4", v
        elif state == "u4" and u[2] >= v:
            u[2] = v
        elif state == "u4":
            p[1], state = c[i - 1], "u5"
        elif state == "u5" and v > u[1]:
            if p[0] > p[1]:
                out.append((i, 1))
                state = "n"
            else:
                state, u[1] = "u3", v
        elif state == "u5" and v < u[2]:
            state, u[2] = "u4", v
        if state == "n" and v >= hi:
            state, u[0] = "e1", v
        elif state == "e1":
            if v > u[0]:
                u[0] = v
            else:
                p[0], state = c[i - 1], "e2"
        elif state == "e2" and v < hi:
            state, u[1] = "e3", v
        elif state == "e3":
            if v < u[1]:
                u[1] = v
            else:
                state, u[2] = "e4", v
        elif state == "e4":
            if u[2] <= v:
                u[2] = v
            else:
                p[1], state = c[i - 1], "e5"
        elif state == "e5":
            if v < u[1]:
                if p[0] < p[1]:
                    out.append((i, -1))
                    state = "n"
                else:
                    state, u[1] = "e3", v
            elif v > u[2]:
                state, u[2] = "e4", v
        elif v >= hi:
            state, u[0] = "e1", v
        elif v <= lo:
            state, u[0] = "u1", v
    return out


def test_ultimate_searches_follow_the_survey():
    rng = np.random.default_rng(5)
    events = 0
    for _ in range(400):
        x = np.clip(np.round(50 + 8 * rng.normal(0, 1, 120).cumsum() / 3), 0, 100).tolist()
        c = np.round(100 + rng.normal(0, 1, 120).cumsum(), 1).tolist()
        got = [(e[0], int(e[3])) for e in oscillators._swing_divergences(x, c, 30, 70)]
        assert got == survey_swings(x, c, 30, 70)
        events += len(got)
        for i, kind, _, score in oscillators._original_divergences(x, c, 30, 70):
            assert (kind == "bullish") == (score > 0) and 0 <= i < 120
    assert events > 100


def test_lows_after_a_bounce():
    assert oscillators.bounces([5, 4, 5, 3, 4, 2, 3], 0, 1) == [(3, 3), (2, 5)]
    assert oscillators.bounces([5, 6, 5, 7, 6], 0, -1) == [(7, 3)]
    assert oscillators.bounces([5, 4, 3, 2], 0, 1) == []
    # the oscillator at the lower low has to be above its value in the zone
    x, c = [50, 20, 40, 35, 31, 45, 60], [12, 10, 9, 10, 8, 9, 10]
    assert [e[0] for e in oscillators._original_divergences(x, c, 30, 70)] == [5]
    x[4] = 15
    assert [e for e in oscillators._original_divergences(x, c, 30, 70)] == []
