"""Trend indicators: moving averages and their crossings, swing states, Hull averages, stop-and-reverse, trend slopes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import BEARISH, BULLISH, Event, centred, lag, neat, over_largest, ratio, scaled_trend, side, signal_rows, signals, sma, spread, trend, with_ema, with_recurrences, wma

LEGS = ("short", "medium", "long")


def typical_price() -> Column:
    return (F.col("close") + F.col("low") + F.col("high")) / 3.0


def mid_price() -> Column:
    return (F.col("high") + F.col("low")) / 2.0


def percent_change(x: str = "close") -> Column:
    """Change from the row before in percent; 0 for the first."""
    before = F.coalesce(lag(x), F.col(x))
    return F.coalesce(ratio(F.col(x) - before, before) * 100.0, F.lit(0.0))


def simple_average(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("sma", sma("close", n))


def exponential_average(bars: DataFrame, n: int = 20) -> DataFrame:
    return with_ema(bars, ema=("close", n))


def weighted_average(bars: DataFrame, n: int = 9) -> DataFrame:
    return bars.withColumn("wma", wma("close", n))


def windowed_average(bars: DataFrame, n: int = 10, strength: float | None = None) -> DataFrame:
    return bars.withColumn("windowed", centred("close", n, strength))


def offset_trim(df: DataFrame, offset: int) -> DataFrame:
    """Rows from offset on."""
    return df.filter(F.col("i") >= offset)


def distance(average: str) -> Column:
    """Distance of the close from an average in percent, three digits."""
    return F.bround(ratio(F.col("close") - F.col(average), average) * 100.0, 3)


def triple_average(bars: DataFrame, config: tuple[int, int, int] = (12, 50, 200), kind: str = "sma") -> DataFrame:
    """Columns short, medium, long and their distances from the close; a leg longer than the series is null."""
    if kind == "sma":
        df = bars.withColumns({leg: sma("close", n) for leg, n in zip(LEGS, config, strict=True)})
    else:
        df = with_ema(bars, **{leg: ("close", n) for leg, n in zip(LEGS, config, strict=True)})
    return df.withColumns({f"{leg}_pct": distance(leg) for leg in LEGS})


def crossovers(averages: DataFrame, config: tuple[int, int, int] = (12, 50, 200)) -> DataFrame:
    """Signals where short crosses medium and medium crosses long; ties keep the side, and the first side counts as a crossing."""
    out = None
    for fast, slow, term, a, b in (("short", "medium", "midterm", config[0], config[1]), ("medium", "long", "longterm", config[1], config[2])):
        df = averages.withColumn("_gap", F.col(fast) - F.col(slow)).withColumn("_side", side("_gap")).withColumn("_was", F.coalesce(lag("_side"), F.lit(0)))
        df = df.filter("short is not null and medium is not null and long is not null")
        turned = F.col("_side").isNotNull() & (F.col("_side") != F.col("_was"))
        kind = F.when(turned, F.when(F.col("_side") > 0, BULLISH).otherwise(BEARISH))
        value = F.when(F.col("_side") > 0, F.lit(f"golden crossover ({term}: {a}d > {b}d)")).otherwise(F.lit(f"death crossover ({term}: {b}d > {a}d)"))
        rows = signal_rows(df, kind, value, F.col("_side"))
        out = rows if out is None else out.unionByName(rows)
    return out


def swing_states(df: DataFrame, after: int) -> DataFrame:
    """df plus state: u3, u2, u1 (short above the others, in order or not), e3, e2, e1 mirrored, n."""
    s, m, g = (F.col(x) for x in LEGS)
    state = (
        F.when(F.col("i") < after, "n").when((s > m) & (m > g), "u3").when((s > m) & (s > g), "u2").when((s > m) | (s > g), "u1")
        .when((s < m) & (m < g), "e3").when((s < m) & (s < g), "e2").when((s < m) | (s < g), "e1").otherwise("n")
    )
    return df.withColumn("state", state)


def _swing(pdf: pd.DataFrame) -> tuple[np.ndarray, list[Event]]:
    """Scores by row and the events among them. block keeps a confirmed trend from being confirmed again."""
    state, close, long = pdf["state"].tolist(), pdf["close"].to_numpy(), pdf["long"].to_numpy()
    score, events, block = np.zeros(len(state)), [], ""
    for i in range(1, len(state)):
        now, was = state[i], state[i - 1]
        if now == "u2":
            if was[0] == "e":
                score[i], block = 0.5, "u1"
                events.append((i, BULLISH, "swing crossover", 0.5))
        elif now == "u3" and was != "u3" and block != "u":
            score[i], block = 1.0, "u"
            events.append((i, BULLISH, "confirmed bull trend", 1.0))
        elif close[i] > long[i]:
            score[i] = 0.1
        elif now == "e2":
            if was[0] == "u":
                score[i], block = -0.5, "e1"
                events.append((i, BEARISH, "swing crossover", -0.5))
        elif now == "e3" and was != "e3" and block != "e":
            score[i], block = -1.0, "e"
            events.append((i, BEARISH, "confirmed bear trend", -1.0))
        elif close[i] < long[i]:
            score[i] = -0.1
    return score, events


def swing_trade(bars: DataFrame, config: tuple[int, int, int] = (4, 9, 18), kind: str = "sma") -> DataFrame:
    """bars plus the three averages (simple, exponential or Hull), state, swing and metric (swing spread and averaged)."""
    df = hull_average(bars, config) if kind == "hull" else triple_average(bars, config, kind)
    df = with_recurrences(swing_states(df, config[2]), swing=lambda p: _swing(p)[0])
    df = df.withColumn("_spread", spread("swing", (1.0, 0.55, 0.25, 0.1)))
    if kind == "hull":
        df = df.withColumn("_spread", over_largest("_spread"))
    return df.withColumn("metric", sma("_spread", 7)).drop("_spread")


def swing_signals(bars: DataFrame, config: tuple[int, int, int] = (4, 9, 18), kind: str = "sma") -> DataFrame:
    df = hull_average(bars, config) if kind == "hull" else triple_average(bars, config, kind)
    out = signals(swing_states(df, config[2]), lambda p: iter(_swing(p)[1]), "close", "long", "state")
    return out.withColumn("value", F.concat("value", F.lit(f" ({config[0]}-{config[1]}-{config[2]})")))


def hull_average(bars: DataFrame, config: tuple[int, int, int] = (9, 16, 36)) -> DataFrame:
    """Hull averages as short, medium and long: the weighted average of 2 * WMA(n / 2) - WMA(n) over sqrt(n) rows."""
    df = bars.withColumns({f"_{leg}": wma("close", n // 2) * 2.0 - wma("close", n) for leg, n in zip(LEGS, config, strict=True)})
    df = df.withColumns({leg: wma(f"_{leg}", int(round(n**0.5))) for leg, n in zip(LEGS, config, strict=True)})
    return df.drop(*[f"_{leg}" for leg in LEGS]).withColumns({f"{leg}_pct": distance(leg) for leg in LEGS})


def auto_trend(bars: DataFrame, periods: tuple[float, ...] = (28, 56, 84), weights: tuple[float, ...] = (0.3, 0.4, 0.3), normalize: bool = True) -> DataFrame:
    """bars plus trend: weighted slopes over the rows before each row."""
    df = bars.withColumn("_trend", trend("close", periods, weights))
    return df.withColumn("trend", scaled_trend("_trend") if normalize else F.col("_trend")).drop("_trend")


def _sar(pdf: pd.DataFrame, factors: tuple[float, ...], largest: float, offset: int) -> tuple[list[np.ndarray], list[Event]]:
    """One series for each acceleration; side and extreme carry over from the end of one pass to the next."""
    high, low, close = (pdf[c].to_numpy() for c in ("high", "low", "close"))
    series, events = [], []
    if len(close) < offset:
        return [close.copy() for _ in factors], events
    rising = len(close) >= offset and np.polyfit(np.arange(4), close[offset - 5 : offset - 1], 1)[0] > 0
    top, bottom = high[:offset].max(), low[:offset].min()
    sar = np.array(close, float)
    sar[offset - 1], extreme = (bottom, top) if rising else (top, bottom)
    for name, base in zip(("fast", "slow"), factors, strict=False):
        factor = base
        for i in range(offset, len(sar)):
            now = sar[i - 1] + factor * (extreme - sar[i - 1])
            against, along = (low[i], high[i]) if rising else (high[i], low[i])
            if (against < now) if rising else (against > now):
                now, extreme, factor, rising = extreme, against, base, not rising
                events.append((i, BULLISH if rising else BEARISH, f"downtrend broken-{name}" if rising else f"upward broken-{name}", 1.0 if rising else -1.0))
            elif (along > extreme) if rising else (along < extreme):
                extreme, factor = along, min(factor + base, largest)
            sar[i] = now
        series.append(sar.copy())
    return series, events


def parabolic_sar(bars: DataFrame, factors: tuple[float, float] = (0.02, 0.01), largest: float = 0.2, offset: int = 5) -> DataFrame:
    """bars plus sar_fast and sar_slow and the close's distance from each in percent."""
    df = with_recurrences(bars, sar_fast=lambda p: _sar(p, factors, largest, offset)[0][0], sar_slow=lambda p: _sar(p, factors, largest, offset)[0][1])
    return df.withColumns({f"{x}_pct": F.bround(ratio(F.col("close") - F.col(x), x) * 100.0, 3) for x in ("sar_fast", "sar_slow")})


def sar_signals(bars: DataFrame, factors: tuple[float, float] = (0.02, 0.01), largest: float = 0.2, offset: int = 5) -> DataFrame:
    return signals(bars, lambda p: iter(_sar(p, factors, largest, offset)[1]), "high", "low", "close")


def trend_report(bars: DataFrame, periods: tuple[int, ...] = (50, 25, 12)) -> DataFrame:
    """For each symbol and period, the last distance of the close from its average and the mean distance."""
    df = bars.withColumns({f"d{p}": F.col("close") - sma("close", p) for p in periods})
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"d{p}").alias("difference")) for p in periods])).alias("x")
    out = df.select("symbol", "i", each).groupBy("symbol", "x.period").agg(F.max_by("x.difference", "i").alias("last_difference"), F.avg("x.difference").alias("mean_difference"))
    return out.select("symbol", "period", neat("last_difference").alias("last_difference"), neat("mean_difference").alias("mean_difference"), F.when(F.col("last_difference") > 0, "above").when(F.col("last_difference") < 0, "below").otherwise("at").alias("side"))

