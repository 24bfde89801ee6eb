"""Candlestick classification and patterns, as SQL conditions over a row and the rows before it.

In a condition o, h, l, c are prices, w is true for a white candle, b the body (long, normal, short), q the body by price quartiles,
d a doji, s the shadow ratio and t the side of the 10-row average (above, below, at); the digit is the candle, 0 the oldest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import lag, signal_rows, sma, stretches, with_ema
from .oscillators import stochastic

Rule = tuple[str, str, str]

# Days, weight, and for each outcome its type, style and condition; the first condition that holds counts.
PATTERNS: dict[str, tuple[int, int, list[Rule]]] = {
    "doji": (1, 1, [("bullish", "dragonfly", "d0")]),  # close takes the place of the high, so that the test always holds
    "dark cloud piercing line": (2, 1, [
        ("bearish", "darkcloud", "t0 = 'above' AND b0 = 'long' AND w0 AND o1 > h0 AND c1 <= (c0 - o0) / 2.0 + o0"),
        ("bullish", "piercing line", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND o1 < l0 AND c1 >= (c0 - o0) / 2.0 + o0")]),
    "evening morning star": (3, 1, [
        ("bearish", "evening star DOJI", "t0 = 'above' AND b0 = 'long' AND w0 AND o1 > c0 AND b1 = 'short' AND c1 > c0 AND o2 < least(c1, o1) AND c2 <= (c0 - o0) / 2.0 + o0 AND d1"),
        ("bearish", "evening star", "t0 = 'above' AND b0 = 'long' AND w0 AND o1 > c0 AND b1 = 'short' AND c1 > c0 AND o2 < least(c1, o1) AND c2 <= (c0 - o0) / 2.0 + o0"),
        ("bullish", "morning star: DOJI", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND o1 < c0 AND b1 = 'short' AND c1 < c0 AND o2 > greatest(c1, o1) AND c2 >= (c0 - o0) / 2.0 + o0 AND d1"),
        ("bullish", "morning star", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND o1 < c0 AND b1 = 'short' AND c1 < c0 AND o2 > greatest(c1, o1) AND c2 >= (c0 - o0) / 2.0 + o0")]),
    "three methods": (5, 1, [  # candles 2 and 3 are candle 1 again
        ("bullish", "rising three methods", "t0 = 'above' AND b0 = 'long' AND w0 AND h0 >= greatest(o1, c1) AND l0 <= least(o1, c1) AND b1 = 'short' AND b4 = 'long' AND w4 AND c4 > c0"),
        ("bearish", "falling three methods", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND l0 <= least(o1, c1) AND h0 >= greatest(o1, c1) AND b1 = 'short' AND b4 = 'long' AND NOT w4 AND c4 < c0")]),
    "hammer": (1, 1, [("bullish", "+", "t0 = 'below' AND b0 = 'short' AND s0 >= 2.0 AND greatest(c0 - l0, o0 - l0) >= (h0 - l0) * 0.99")]),
    "hanging man": (1, 1, [("bearish", "-", "t0 = 'above' AND b0 = 'short' AND s0 >= 2.0 AND greatest(c0 - l0, o0 - l0) >= (h0 - l0) * 0.99")]),
    "inverted hammer": (2, 1, [("bullish", "+", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND b1 = 'short' AND s1 >= 2.0 AND least(c1 - l1, o1 - l1) <= (h1 - l1) * 0.01")]),
    "shooting star": (2, 1, [("bearish", "-", "t0 = 'above' AND b0 = 'long' AND w0 AND c0 < h0 AND b1 = 'short' AND s1 >= 2.0 AND o1 > c0 AND c1 > c0 AND least(c1 - l1, o1 - l1) <= (h1 - l1) * 0.01")]),
    "belt hold": (1, 1, [
        ("bullish", "+", "t0 = 'below' AND w0 AND o0 - l0 <= (h0 - l0) * 0.005 AND h0 > c0"),
        ("bearish", "-", "t0 = 'above' AND NOT w0 AND o0 - l0 >= (h0 - l0) * 0.995 AND l0 < c0")]),
    "engulfing": (2, 1, [
        ("bullish", "+", "t0 = 'below' AND NOT w0 AND b1 = 'long' AND w1 AND h0 <= c1 AND l0 >= o1"),
        ("bearish", "-", "t0 = 'above' AND w0 AND b1 = 'long' AND NOT w1 AND h0 <= o1 AND l0 >= c1")]),
    "harami": (2, 1, [
        ("bullish", "cross-+", "t0 = 'below' AND NOT w0 AND b0 = 'long' AND w1 AND h1 <= o0 AND l1 >= c1 AND abs(c1 - o1) <= (h1 - l1) * 0.01"),
        ("bullish", "+", "t0 = 'below' AND NOT w0 AND b0 = 'long' AND w1 AND h1 <= o0 AND l1 >= c1"),
        ("bearish", "cross--", "t0 = 'above' AND w0 AND b0 = 'long' AND NOT w1 AND h1 <= c0 AND l1 >= o1 AND abs(o1 - c1) <= (h1 - l1) * 0.01"),
        ("bearish", "-", "t0 = 'above' AND w0 AND b0 = 'long' AND NOT w1 AND h1 <= c0 AND l1 >= o1")]),
    "doji star": (2, 1, [
        ("bullish", "+", "t0 = 'below' AND NOT w0 AND b0 <> 'short' AND h1 <= c0 AND d1"),
        ("bearish", "-", "t0 = 'above' AND w0 AND b0 <> 'short' AND l1 >= c0 AND d1")]),
    "meeting line": (2, 1, [
        ("bullish", "+", "t0 = 'below' AND b0 <> 'short' AND NOT w0 AND w1 AND b1 <> 'short' AND abs(c0 - c1) <= (h1 - l1) * 0.01"),
        ("bearish", "-", "t0 = 'above' AND b0 <> 'short' AND w0 AND NOT w1 AND b1 <> 'short' AND abs(c0 - c1) <= (h1 - l1) * 0.01")]),
    "three soldier crows": (3, 1, [
        ("bullish", "white soldiers", "t0 = 'below' AND w0 AND b0 <> 'short' AND w1 AND b1 <> 'short' AND o1 > (c0 - o0) * 0.3 + o0 AND c1 > c0 AND o1 < c0 AND w2 AND b2 <> 'short' AND o2 > (c1 - o1) * 0.3 + o1 AND c2 > c1 AND o2 < c1"),
        ("bearish", "black crows", "t0 = 'above' AND NOT w0 AND b0 <> 'short' AND NOT w1 AND b1 <> 'short' AND o1 < (c0 - o0) * 0.7 + o0 AND c1 < c0 AND o1 > c0 AND NOT w2 AND b2 <> 'short' AND o2 < (c1 - o1) * 0.7 + o1 AND c2 < c1 AND o2 > c1")]),
    "tri star": (3, 3, [
        ("bullish", "tri star +", "t0 = 'below' AND d0 AND d1 AND d2 AND c1 < c0 AND c1 < c2"),
        ("bearish", "tri star -", "t0 = 'above' AND d0 AND d1 AND d2 AND c1 > c0 AND c1 > c2")]),
    "breakaway": (5, 1, [
        ("bullish", "breakaway +", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND l0 > h1 AND b1 = 'short' AND NOT w1 AND c2 < o1 AND o2 < o1 AND l2 < l1 AND b3 = 'short' AND NOT w3 AND l3 < l2 AND b4 = 'long' AND w4 AND c4 > o1 AND c4 <= c0"),
        ("bearish", "breakaway -", "t0 = 'above' AND b0 = 'long' AND w0 AND h0 < l1 AND b1 = 'short' AND w1 AND c2 > o1 AND o2 > o1 AND h2 > h1 AND b3 = 'short' AND w3 AND h3 > h2 AND b4 = 'long' AND NOT w4 AND c4 < o1 AND c4 >= c0")]),
    "three inside": (3, 1, [
        ("bullish", "up", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND b1 = 'short' AND w1 AND o1 > c0 AND c1 < o0 AND w2 AND o2 > o1 AND o2 < c1 AND c2 > o0"),
        ("bearish", "down", "t0 = 'above' AND b0 = 'long' AND w0 AND b1 = 'short' AND NOT w1 AND o1 < c0 AND c1 > o0 AND NOT w2 AND o2 > c1 AND o2 < o1 AND c2 < o0")]),
    "three outside": (3, 1, [  # the last close is held against itself: never
        ("bullish", "up", "t0 = 'below' AND NOT w0 AND b0 <> 'long' AND b1 = 'long' AND w1 AND l0 > o1 AND h0 < c1 AND w2 AND o2 > o1 AND o2 < c1 AND c2 > c2"),
        ("bearish", "down", "t0 = 'above' AND w0 AND b0 <> 'long' AND b1 = 'long' AND NOT w1 AND l0 > c1 AND h0 < o1 AND NOT w2 AND o2 < o1 AND o2 > c1 AND c2 < c2")]),
    "kicking": (2, 1, [
        ("bullish", "+", "b0 = 'long' AND NOT w0 AND b1 = 'long' AND w1 AND h0 - o0 <= abs(o0 - c0) * 0.01 AND c0 - l0 <= abs(o0 - c0) * 0.01 AND h1 - c1 <= abs(o1 - c1) * 0.01 AND o1 - l1 <= abs(o1 - c1) * 0.01 AND h0 < l1"),
        ("bearish", "-", "b0 = 'long' AND w0 AND b1 = 'long' AND NOT w1 AND h0 - c0 <= abs(c0 - o0) * 0.01 AND o0 - l0 <= abs(c0 - o0) * 0.01 AND h1 - o1 <= abs(o1 - c1) * 0.01 AND c1 - l1 <= abs(o1 - c1) * 0.01 AND l0 > h1")]),
    "three river": (3, 1, [("bullish", "+", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND b1 = 'short' AND NOT w1 AND s1 >= 2.0 AND h1 - o1 <= (o1 - c1) * 0.02 AND o1 < o0 AND l1 < c0 AND w2 AND o2 >= c0 AND c2 <= c1")]),
    "three stars": (3, 1, [("bullish", "in the south +", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND s0 >= 1.6 AND h0 - o0 <= abs(c0 - o0) * 0.01 AND b1 = 'short' AND NOT w1 AND o1 < (o0 - c0) * 0.2 + c0 AND o1 > c0 AND c1 < c0 AND l1 > l0 AND s2 <= 1.03 AND NOT w2 AND b2 = 'short' AND o2 < (o1 - c1) * 0.5 + c1 AND c2 < c1")]),
    "concealing baby": (4, 1, [("bullish", "swallow +", "t0 = 'below' AND b0 <> 'short' AND NOT w0 AND s0 <= 1.03 AND b1 <> 'short' AND NOT w1 AND s1 <= 1.03 AND o1 < (o0 - c0) * 0.5 + c0 AND o1 >= c0 AND b2 = 'short' AND NOT w2 AND s2 >= 1.6 AND c2 - l2 <= (o2 - c2) * 0.02 AND o2 < c1 AND h2 >= c1 AND NOT w3 AND b3 <> 'short' AND s3 <= 1.03 AND c3 <= c2 AND o3 > o2")]),
    "stick sandwich": (3, 1, [
        ("bullish", "+", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND c0 - l0 <= (o0 - c0) * 0.02 AND b1 = 'long' AND w1 AND s1 <= 1.03 AND o1 > c0 AND o1 < o0 AND b2 = 'long' AND NOT w2 AND c0 <= (o2 - c2) * 0.05 + c2 AND c0 >= c2 - (o2 - c2) * 0.05 AND o2 > c1"),
        ("bearish", "-", "t0 = 'above' AND b0 = 'long' AND w0 AND h0 - c0 <= (c0 - o0) * 0.02 AND b1 = 'long' AND NOT w1 AND s1 <= 1.03 AND o1 > o0 AND o1 < c0 AND b2 = 'long' AND w2 AND c0 <= (c2 - o2) * 0.05 + c2 AND c0 >= c2 - (c2 - o2) * 0.05 AND o2 < c1")]),
    "identical crows": (3, 1, [("bearish", "-", "t0 = 'above' AND b0 <> 'short' AND NOT w0 AND b1 <> 'short' AND NOT w1 AND o1 <= (o0 - c0) * 0.03 + c0 AND c1 >= c0 - (o0 - c0) * 0.03 AND b2 <> 'short' AND NOT w2 AND o2 <= (o1 - c1) * 0.03 + c1 AND o2 >= c1 - (o1 - c1) * 0.03 AND o1 - c1 <= (o0 - c0) * 0.95 AND o2 - c2 <= (o0 - c0) * 0.95")]),
    "deliberation": (3, 1, [("bearish", "-", "t0 = 'above' AND b0 = 'long' AND w0 AND b1 = 'long' AND o1 > (c0 - o0) * 0.5 AND o1 < c0 AND c1 > c0 AND (b2 = 'short' OR w2) AND o2 > c1")]),
    "matching": (2, 1, [
        ("bullish", "low", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND NOT w1 AND o1 < o0 AND c1 <= (o0 - c0) * 0.03 + c0 AND c1 >= c0 - (o0 - c0) * 0.03"),
        ("bearish", "high", "t0 = 'above' AND b0 = 'long' AND w0 AND w1 AND o1 > o0 AND c1 <= (c0 - o0) * 0.03 + c0 AND c1 >= c0 - (c0 - o0) * 0.03")]),
    "two crows": (3, 1, [
        ("bearish", "upside_gap--", "t0 = 'above' AND b0 = 'long' AND w0 AND b1 = 'short' AND NOT w1 AND c1 > c0 AND o2 >= o1 AND c2 <= c1 AND c2 > c0"),
        ("bearish", "-", "t0 = 'above' AND b0 = 'long' AND w0 AND b1 = 'short' AND NOT w1 AND c1 > c0 AND o2 > c1 AND o2 < o1 AND c2 < c1 AND c2 > o1")]),
    "homing pigeon": (2, 1, [("bullish", "+", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND b1 <> 'long' AND NOT w1 AND o1 < o0 AND c1 > c0")]),
    "ladder": (5, 1, [
        ("bullish", "bottom +", "t0 = 'below' AND b0 <> 'short' AND NOT w0 AND b1 <> 'short' AND NOT w1 AND o1 < o0 AND o1 > c0 AND c1 < c0 AND b2 <> 'short' AND NOT w2 AND o2 < o1 AND o2 > c1 AND c2 < c1 AND b3 = 'short' AND NOT w3 AND s3 >= 2.0 AND c3 < c2 AND c3 - l3 <= (o3 - c3) * 0.1 AND b4 = 'long' AND w4 AND o4 > o3"),
        ("bearish", "top -", "t0 = 'above' AND b0 <> 'short' AND w0 AND b1 <> 'short' AND w1 AND o1 > o0 AND o1 < c0 AND c1 > c0 AND b2 <> 'short' AND w2 AND o2 > o1 AND o2 < c1 AND c2 > c1 AND b3 = 'short' AND w3 AND s3 >= 2.0 AND c3 > c2 AND h3 - c3 <= (o3 - c3) * 0.1 AND q4 = 'long' AND NOT w4 AND o4 < o3")]),
    "advance block": (3, 1, [("bearish", "-", "t0 = 'above' AND w0 AND o1 > o0 AND o1 < c0 AND c1 > c0 AND w1 AND b2 = 'short' AND w2 AND o2 > o1 AND o2 < c1 AND c2 > c1")]),
    "separating lines": (2, 1, [
        ("bullish", "+", "t0 = 'above' AND b0 = 'long' AND NOT w0 AND b1 = 'long' AND w1 AND o1 <= o0 + abs(o0 - c0) * 0.05 AND o1 >= o0 - abs(o0 - c0) * 0.05"),
        ("bearish", "-", "t0 = 'below' AND b0 = 'long' AND w0 AND b1 = 'long' AND NOT w1 AND o1 <= o0 + abs(c0 - o0) * 0.05 AND o1 >= o0 - abs(c0 - o0) * 0.05")]),
    "tasuki gap": (3, 1, [
        ("bullish", "upside +", "t0 = 'above' AND b0 = 'long' AND w0 AND w1 AND l1 > h0 AND NOT w2 AND o2 <= c1 AND o2 >= o1 AND c2 < o1 AND c2 > c0"),
        ("bearish", "downside -", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND NOT w1 AND l0 > h1 AND w2 AND o2 <= o1 AND o2 >= c1 AND c2 > o1 AND c2 < c0")]),
    "side by side": (3, 1, [
        ("bullish", "white lines +", "t0 = 'above' AND b0 = 'long' AND w0 AND w1 AND l1 > h0 AND w2 AND l2 > h0 AND o2 >= o1 - (c1 - o1) * 0.1 AND o2 <= o1 + (c1 - o1) * 0.1 AND c2 <= c1"),
        ("bearish", "white lines -", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND w1 AND h1 < l0 AND w2 AND h2 < l0 AND o2 >= o1 - (c1 - o1) * 0.1 AND o2 <= o1 + (c1 - o1) * 0.1 AND c2 <= c1")]),
    "three line strike": (4, 1, [
        ("bearish", "-", "t0 = 'below' AND NOT w0 AND NOT w1 AND NOT w2 AND o1 < o0 AND c1 < c0 AND o2 < o1 AND c2 < c1 AND w3 AND o3 <= c2 AND c3 >= o0"),
        ("bullish", "+", "t0 = 'above' AND w0 AND w1 AND w2 AND o1 > o0 AND c1 > c0 AND o2 > o1 AND c2 > c1 AND NOT w3 AND o3 >= c2 AND c3 <= o0")]),
    "gap three methods": (3, 1, [  # both ask for what can't be: never
        ("bearish", "downside -", "t0 = 'below' AND NOT w0 AND NOT w1 AND h1 < l0 AND w2 AND o2 < o1 AND o2 > c1 AND c2 > c0 AND c2 < o2"),
        ("bullish", "upside +", "t0 = 'above' AND w0 AND w1 AND l1 > h0 AND NOT w2 AND o2 < c1 AND o2 > o1 AND c2 > o0 AND c2 < c2")]),
    "neck line": (2, 1, [
        ("bearish", "in -", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND w1 AND o1 < l0 AND c1 >= c0 - (o0 - c0) * 0.05 AND c1 <= c0 + (o0 - c0) * 0.05"),
        ("bearish", "on -", "t0 = 'below' AND b0 = 'long' AND NOT w0 AND w1 AND o1 < l0 AND c1 <= c0 AND c1 >= l0"),
        ("bullish", "in +", "t0 = 'above' AND b0 = 'long' AND w0 AND NOT w1 AND o1 > h0 AND c1 >= c0 - (c0 - o0) * 0.05 AND c1 <= c0 + (c0 - o0) * 0.05"),
        ("bullish", "on +", "t0 = 'above' AND b0 = 'long' AND w0 AND NOT w1 AND o1 > h0 AND c1 >= c0 AND c1 <= h0")]),
}
FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close", "w": "white", "q": "body", "v": "vol_body", "d": "doji", "s": "shadow_ratio", "t": "trend"}
#: Candles before a row that its patterns look at.
BACK = 4


def condition(rule: str, days: int, body: str) -> str:
    """A rule over lagged columns: x_0 is the row itself, x_1 the one before it, and so on."""
    letter = {"b": "q" if body == "body" else "v"}
    return re.sub(r"\b([ohlcwqbdst])([0-4])\b", lambda m: f"{letter.get(m[1], m[1])}_{days - 1 - int(m[2])}", rule)


def classify(bars: DataFrame, long_percentile: float = 0.75, short_percentile: float = 0.25, doji_percentile: float = 0.01, doji_ratio: float = 8.0) -> DataFrame:
    """bars plus trend, body, vol_body, white, doji and shadow_ratio.

    Bodies are long or short by quartiles of |open - close| of the symbol; vol_body holds the high against the low plus shares of
    the averaged range.
    """
    return _classified(bars, long_percentile, short_percentile, doji_percentile, doji_ratio).filter("_own").drop("_part", "_own")


def _classified(bars: DataFrame, long_percentile: float = 0.75, short_percentile: float = 0.25, doji_percentile: float = 0.01, doji_ratio: float = 8.0) -> DataFrame:
    """classify() in stretches, of which a row that isn't a stretch's own is right in its last four rows."""
    size = F.abs(F.col("open") - F.col("close"))
    df = bars.withColumns({"_size": size, "_range": F.abs(F.col("high") - F.col("low"))})
    limits = df.groupBy(F.col("symbol").alias("_symbol")).agg(*[F.percentile("_size", p).alias(f"_p{k}") for k, p in (("long", long_percentile), ("short", short_percentile), ("doji", doji_percentile))])
    df = with_ema(df, _vol=("_range", 25)).join(limits, F.col("symbol").eqNullSafe(F.col("_symbol"))).drop("_symbol")
    df = stretches(df, BACK + 9).withColumn("_sma", sma("close", 10, "_part"))
    df = df.withColumn("shadow_ratio", F.when(F.col("_size") > 0, (F.col("high") - F.col("low")) / F.col("_size")).otherwise(F.lit(0.0)))
    return df.withColumns({
        "trend": F.when(F.col("close") > F.col("_sma"), "above").when(F.col("close") < F.col("_sma"), "below").otherwise("at"),
        "body": F.when(F.col("_size") >= F.col("_plong"), "long").when(F.col("_size") <= F.col("_pshort"), "short").otherwise("normal"),
        "vol_body": F.when(F.col("high") > F.col("low") + F.col("_vol") * long_percentile, "long").when(F.col("high") < F.col("low") + F.col("_vol") * (2 * short_percentile), "short").otherwise("normal"),
        "white": F.col("close") > F.col("open"),
        "doji": (F.col("_size") <= F.col("_pdoji")) & (F.col("shadow_ratio") >= doji_ratio),
    }).drop("_size", "_range", "_sma", "_vol", "_plong", "_pshort", "_pdoji")


def lagged(candles: DataFrame) -> DataFrame:
    """candles in stretches with the columns of conditions. All lags share one window, so that any number of patterns costs one sort."""
    df = candles if "_part" in candles.columns else stretches(candles, BACK)
    return df.withColumns({f"{k}_{j}": (F.col(f) if j == 0 else lag(f, j, "_part")) for k, f in FIELDS.items() for j in range(BACK + 1)})


def outcome(name: str, body: str) -> tuple[Column, Column]:
    """Style and value of a pattern by one kind of body, over lagged(): null and 0 where it isn't seen."""
    days, weight, rules = PATTERNS[name]
    style, value = F.lit(None).cast("string"), F.lit(0)
    for kind, label, rule in reversed(rules):
        holds = (F.col("i") >= days - 1) & F.expr(condition(rule, days, body))
        style = F.when(holds, F.lit(label)).otherwise(style)
        value = F.when(holds, F.lit(weight if kind == "bullish" else -weight)).otherwise(value)
    return style, value


def detected(candles: DataFrame, names: list[str]) -> DataFrame:
    """candles plus, for each pattern, n_<pattern> (its value by both kinds of body) and a list of what was seen, in styles."""
    seen, values = [], {}
    for name in names:
        total: Column = F.lit(0)
        for body in ("body", "vol_body"):
            style, value = outcome(name, body)
            total = total + value
            seen.append(F.struct(F.lit(name).alias("pattern"), F.lit(body).alias("by"), style.alias("style"), value.alias("value")))
        values[f"n_{name.replace(' ', '_')}"] = total
    out = lagged(candles).withColumns(values | {"styles": F.filter(F.array(*seen), lambda x: x["style"].isNotNull())}).filter("_own")
    return out.drop("_part", "_own", *[f"{k}_{j}" for k in FIELDS for j in range(BACK + 1)])


def pattern(bars: DataFrame, name: str) -> DataFrame:
    """symbol, i, value and style of one pattern, by rows where it was seen by either kind of body."""
    (style, value), (other, more) = outcome(name, "body"), outcome(name, "vol_body")
    return lagged(_classified(bars)).filter("_own").select("symbol", "i", (value + more).alias("value"), F.coalesce(style, other).alias("style")).filter("style is not null")


def all_patterns(bars: DataFrame) -> DataFrame:
    """symbol, i, pattern and value for every pattern with a value other than 0."""
    # values are columns before they are rows: Spark interprets what stands within a generator or a function with a lambda
    values = {f"n_{k}": (outcome(name, "body")[1] + outcome(name, "vol_body")[1]).cast("long") for k, name in enumerate(PATTERNS)}
    df = lagged(_classified(bars)).filter("_own").select("symbol", "i", *[v.alias(k) for k, v in values.items()])
    each = F.array(*[F.struct(F.lit(name).alias("pattern"), F.col(k).alias("value")) for k, name in zip(values, PATTERNS, strict=True)])
    return df.select("symbol", "i", F.inline(each)).filter("value <> 0")


def candle_signals(bars: DataFrame) -> DataFrame:
    """A signal for each style seen; its type is the sign of the row's net value."""
    out = detected(_classified(bars), list(PATTERNS))
    net = F.aggregate("styles", F.lit(0), lambda a, x: a + x["value"])
    out = out.select("symbol", "i", "dt", net.alias("net"), F.explode(F.array_distinct(F.transform("styles", lambda x: F.concat_ws(": ", x["pattern"], x["style"])))).alias("style"))
    return signal_rows(out, F.when(F.col("net") > 0, "bullish").when(F.col("net") < 0, "bearish"), F.col("style"), F.col("net"))


#: Patterns that count in an extreme of the stochastic oscillator alone.
REVERSALS = ("dark cloud piercing line", "evening morning star")


def reversal_patterns(bars: DataFrame, names: tuple[str, ...] = REVERSALS, high: float = 80.0, low: float = 20.0, confirmed: bool = True, compat: bool = False) -> DataFrame:
    """symbol, i, dt, value and styles of rows where patterns of a reversal add up to something other than 0.

    If confirmed, those stay whose smoothed stochastic is at high or above, or at low or below, in the row or the one before, and count
    twice. The described test asks for both at once, so that nothing stays; compat does so.
    """
    seen = detected(_classified(bars), list(names)).withColumn("value", F.aggregate("styles", F.lit(0), lambda a, x: a + x["value"]))
    seen = seen.select("symbol", "i", "dt", "value", F.array_join(F.transform("styles", lambda x: F.concat_ws(": ", x["pattern"], x["style"])), ", ").alias("styles")).filter("value <> 0")
    if not confirmed:
        return seen
    extreme = (F.col("smooth_k") >= high) & (F.col("smooth_k") <= low) if compat else (F.col("smooth_k") >= high) | (F.col("smooth_k") <= low)
    zones = stochastic(stretches(bars, 20), within=("_part",)).withColumn("_x", extreme)  # 13 rows of the range, 4 of the two averages and the one before
    zones = zones.withColumn("_x", F.col("_x") | F.coalesce(lag("_x", 1, "_part"), F.lit(False))).filter("_own").select("symbol", "i", "_x")
    return seen.join(zones, ["symbol", "i"]).filter("_x").withColumn("value", F.col("value") * 2).drop("_x")
