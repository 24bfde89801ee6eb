"""Oscillators: their series as window expressions, their events as state machines over those series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import BEARISH, BULLISH, Event, ema, impulses, lag, neat, over_largest, ratio, rows, scaled_trend, side, signal_rows, signals, sma, smooth_metric, spread, trend, whole, with_ema, with_recurrences
from .trend import mid_price, percent_change, typical_price

#: Weights by which an event spreads to its row and to the three on either side.
SPREADS = {
    "stochastic": (1.0, 0.85, 0.55, 0.1), "rsi": (1.0, 0.85, 0.55, 0.1), "cluster": (1.0, 0.85, 0.55, 0.1), "ultimate": (1.0, 0.9, 0.75, 0.45), "macd": (1.0, 0.85, 0.55, 0.2),
    "bear_bull": (1.0, 0.75, 0.45, 0.1), "total_power": (1.0, 0.85, 0.6, 0.25), "bollinger": (1.0, 0.6, 0.25, 0.0), "awesome": (1.0, 0.85, 0.5, 0.05), "momentum": (1.3, 0.85, 0.55, 0.1),
}


def _v(pdf: pd.DataFrame, *columns: str) -> list[list[float]]:
    return [pdf[c].tolist() for c in columns]


# --- stochastic ----------------------------------------------------------------------------------------------------------------------


def stochastic(bars: DataFrame, k: int = 14, smooth: int = 3, slow: int = 3, within: tuple[str, ...] = ()) -> DataFrame:
    """bars plus fast_k (50 for the first rows and where the range is flat), smooth_k and slow_d. Windows are by symbol and within."""
    low, high = F.min("low").over(rows(1 - k, 0, *within)), F.max("high").over(rows(1 - k, 0, *within))
    fast = F.when(F.col("i") < k - 1, F.lit(50.0)).otherwise(F.coalesce(ratio(F.col("close") - low, high - low) * 100.0, F.lit(50.0)))
    df = bars.withColumn("fast_k", fast)
    df = df.withColumn("smooth_k", F.when(F.col("i") < k - 1, F.lit(50.0)).otherwise(F.avg("fast_k").over(rows(1 - smooth, 0, *within))))
    return df.withColumn("slow_d", F.when(F.col("i") < k - 1, F.lit(50.0)).otherwise(F.avg("smooth_k").over(rows(1 - slow, 0, *within))))


def _zone_crossings(fast: list[float], slow: list[float], name: str, high: float = 80.0, low: float = 20.0) -> Iterator[Event]:
    """Both lines enter a zone, the faster one crosses back over the slower one and leaves the zone."""
    zone, step = 0, 0
    for i, (f, s) in enumerate(zip(fast, slow, strict=True)):
        if zone == 0:
            zone, step = (1, 1) if f >= high else (-1, 1) if f <= low else (0, 0)
            continue
        edge = high if zone > 0 else low
        within, slow_within = zone * (f - edge) >= 0, zone * (s - edge) >= 0
        if step == 1:
            if not within:
                zone = 0
            elif slow_within:
                step = 2
        elif step == 2:
            if zone * (f - s) < 0:
                step = 3
        elif not within:
            yield i, BEARISH if zone > 0 else BULLISH, name, -1.0 * zone
            zone = 0


def _zone_divergences(x: list[float], close: list[float], name: str, high: float = 80.0, low: float = 20.0) -> Iterator[Event]:
    """Two peaks of the oscillator in a zone that move against the two prices."""
    zone, step, first, second, p0 = 0, 0, 0.0, 0.0, 0.0
    for i, v in enumerate(x):
        if zone == 0:
            if v >= high or v <= low:
                zone, step, first = (1 if v >= high else -1), 1, v
            continue
        d = zone  # seen from the upper zone
        edge = high if zone > 0 else low
        if step == 1:
            if d * (v - first) < 0:
                p0, step = close[i], 2
            else:
                first = v
        elif step == 2:
            if d * (v - edge) < 0:
                step, second = 3, v
            elif d * (v - first) > 0:
                first, step = v, 1
        elif step == 3:
            if d * (v - second) > 0:
                step = 4
            second = v
        elif d * (v - second) < 0:
            p1 = close[i - 1]
            if d * (p1 - p0) > 0 and d * (first - second) > 0:
                yield i, BEARISH if d > 0 else BULLISH, name, -1.5 * d
            zone = 0
        else:
            second = v
            if d * (second - first) > 0:
                first, step = v, 1


def stochastic_signals(bars: DataFrame, k: int = 14, smooth: int = 3, slow: int = 3) -> DataFrame:
    def machines(p: pd.DataFrame) -> Iterator[Event]:
        f, s, d, c = _v(p, "fast_k", "smooth_k", "slow_d", "close")
        yield from _zone_crossings(f, s, "fast-smooth crossover")
        yield from _zone_crossings(s, d, "smooth-slow crossover")
        for x, name in ((f, "fast"), (s, "smooth"), (d, "slow")):
            yield from _zone_divergences(x, c, f"{name} divergence")

    return signals(stochastic(bars, k, smooth, slow), machines, "fast_k", "smooth_k", "slow_d", "close")


# --- relative strength index ---------------------------------------------------------------------------------------------------------


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """bars plus rsi: 50 for the first rows; averages of gains and losses are plain means over the rows before."""
    change = F.round(percent_change(), 6)
    df = bars.withColumn("_d", change).withColumns({"_g": F.greatest(F.col("_d"), F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    df = df.withColumns({f"_{a}{j}": F.bround(F.sum(f"_{a}").over(rows(-period - j, -1 - j)) / period, 6) for a in "gl" for j in (0, 1)})
    first = ratio("_g0", "_l0")
    later_loss = (F.col("_l1") * (period - 1) + F.col("_l")) / float(period)
    later = F.when(F.col("_l1") != 0, ratio((F.col("_g1") * (period - 1) + F.col("_g")) / float(period), later_loss))
    strength = F.when(F.col("i") == period, first).otherwise(later)
    value = F.when(F.col("i") < period, F.lit(50.0)).otherwise(F.coalesce(F.bround(F.lit(100.0) - F.lit(100.0) / (strength + 1.0), 6), F.lit(100.0)))
    return df.withColumn("rsi", value).drop("_d", "_g", "_l", "_g0", "_g1", "_l0", "_l1")


def rsi_thresholds(bars: DataFrame, period: int = 14, overbought: float = 70.0, oversold: float = 30.0) -> DataFrame:
    """bars plus rsi, overbought and oversold: thresholds that give way to the trend."""
    df = rsi(bars, period).withColumn("_raw", trend("close", (period * 3, period * 5.5, period * 8), (0.45, 0.33, 0.22))).withColumn("_s", scaled_trend("_raw"))
    up = F.lit(oversold) + 10.0 - F.lit(10.0) * F.exp((F.col("_s") - 0.1) * -15.0)
    down = F.lit(overbought) - (F.lit(10.0) - F.lit(10.0) * F.exp((F.col("_s") + 0.1) * 15.0))
    df = df.withColumns({"oversold": F.when(F.col("_s") > 0.1, up).otherwise(F.lit(oversold)), "overbought": F.when(F.col("_s") < -0.1, down).otherwise(F.lit(overbought))})
    return df.drop("_raw", "_s")


def _rejections(x: list[float], lo: list[float], hi: list[float]) -> Iterator[Event]:
    """Out of a zone, back towards it without entering, and away again beyond the first turn."""
    at, top, low = 0, 0.0, 0.0
    for i, v in enumerate(x):
        if at == 0:
            at = 1 if v <= lo[i] else 5 if v >= hi[i] else 0
        elif at == 1:
            if v > lo[i]:
                at, top = 2, v
        elif at == 2:
            if v >= top:
                at, top = (5, top) if v >= hi[i] else (2, v)
            else:
                at, low = 3, v
        elif at == 3:
            if v <= lo[i]:
                at = 1
            elif v <= low:
                low = v
            else:
                at = 4
        elif at == 4:
            if v > top:
                yield i, BULLISH, "swing rejection", 1.0
                at, top, low = 0, 0.0, 0.0
            elif v <= lo[i]:
                at = 1
        elif at == 5:
            if v < hi[i]:
                at, low = 6, v
        elif at == 6:
            if v <= low:
                at, low = (1, low) if v <= lo[i] else (6, v)
            else:
                at, top = 7, v
        elif at == 7:
            if v >= hi[i]:
                at = 5
            elif v >= top:
                top = v
            else:
                at = 8
        elif v < low:
            yield i, BEARISH, "swing rejection", -1.0
            at, top, low = 0, 0.0, 0.0
        elif v >= hi[i]:
            at = 5


def _rsi_divergences(x: list[float], close: list[float], lo: list[float], hi: list[float]) -> Iterator[Event]:
    d, step = 0, 0  # d: 1 from the oversold side, -1 from the overbought side
    r0 = r1 = p0 = p1 = turn = 0.0
    for i, v in enumerate(x):
        if d == 0:
            if v <= lo[i] or v >= hi[i]:
                d, step, r0 = (1 if v <= lo[i] else -1), 1, v
            continue
        near, far = (lo[i], hi[i]) if d > 0 else (hi[i], lo[i])
        if step == 1:
            if d * (v - r0) <= 0:
                r0, p0 = v, close[i]
            else:
                step, turn = 2, v
        elif step == 2:
            if d * (v - turn) >= 0:
                if d * (v - far) >= 0:
                    d, step, r0 = -d, 1, v
                else:
                    turn = v
            else:
                step, r1 = 3, v
        elif d * (v - r1) <= 0:
            p1, r1 = close[i], v
        else:
            if d * (r1 - near) <= 0 and d * (p1 - p0) < 0 and d * (r1 - r0) > 0:
                yield i, BULLISH if d > 0 else BEARISH, "divergence", float(d)
            d = 0


def rsi_signals(bars: DataFrame, period: int = 14) -> DataFrame:
    def machines(p: pd.DataFrame) -> Iterator[Event]:
        x, c, lo, hi = _v(p, "rsi", "close", "oversold", "overbought")
        yield from _rejections(x, lo, hi)
        yield from _rsi_divergences(x, c, lo, hi)

    return signals(rsi_thresholds(bars, period), machines, "rsi", "close", "oversold", "overbought")


# --- ultimate oscillator -------------------------------------------------------------------------------------------------------------


def ultimate(bars: DataFrame, config: tuple[int, int, int] = (7, 14, 28)) -> DataFrame:
    """bars plus ultimate: buying pressure over true range, of n + 1 rows for each n, weighted 4, 2 and 1; 50 for the first rows."""
    before = lag("close")
    low, high = F.least("low", before), F.greatest("high", before)
    df = bars.withColumns({"_bp": F.when(F.col("i") > 0, F.bround(F.col("close") - low, 6)).otherwise(F.lit(0.0)), "_tr": F.when(F.col("i") > 0, F.bround(high - low, 6)).otherwise(F.lit(0.0))})
    parts = [F.when(F.col("i") >= n, F.coalesce(ratio(F.sum("_bp").over(rows(-n, 0)), F.sum("_tr").over(rows(-n, 0))), F.lit(0.0))).otherwise(F.lit(0.0)) for n in config]
    value = F.lit(100.0) * (parts[0] * 4.0 + parts[1] * 2.0 + parts[2]) / 7.0
    return df.withColumn("ultimate", F.when(F.col("i") < config[2] - 1, F.lit(50.0)).otherwise(value)).drop("_bp", "_tr")


def bounces(close: list[float], start: int, d: int) -> list[tuple[float, int]]:
    """Lower lows (d = 1) or higher highs (-1) after start that were followed by a bounce: price and row of the low."""
    out: list[tuple[float, int]] = []
    extreme, at, seen = close[start], start, "nothing"
    for i in range(start, len(close)):
        below = d * (close[start] - close[i]) > 0
        if below and seen in ("nothing", "descent"):
            extreme, at, seen = close[i], i, "descent"
        step = d * (close[i] - extreme)
        if step > 0 and seen == "descent":
            seen = "bounce"
        elif step < 0 and seen in ("bounce", "lower", "told"):
            extreme, at, seen = close[i], i, "lower"
        elif step > 0 and seen == "lower":
            out.append((extreme, at))
            seen = "told"
    return out


def _original_divergences(x: list[float], close: list[float], lo: float, hi: float) -> Iterator[Event]:
    """A zone, then a lower low of the close at which the oscillator is above its value in the zone, then a break through the
    oscillator's extreme in between (all upside down from the upper zone)."""
    for i, v in enumerate(x):
        d = 1 if v < lo else -1 if v > hi else 0
        lows = bounces(close, i, d) if d else []
        if not lows or d * (x[lows[-1][1]] - v) <= 0:
            continue
        low = lows[-1][1]
        barrier = max(d * y for y in x[i : low + 1])
        broken = next((j for j in range(low, len(x)) if d * x[j] > barrier), None)
        if broken is not None:
            yield broken, BULLISH if d > 0 else BEARISH, "divergence (original)", float(d)


class _Swing:
    """Search for a low in a zone, a peak outside, a second low, and a break through the peak. Values are turned by d, so that the
    search from the upper zone is the same one upside down."""

    def __init__(self, d: int, zone: float, v: float):
        self.d, self.zone = d, d * zone
        self.stage, self.low, self.peak, self.dip = "falling", d * v, 0.0, 0.0

    def broken(self, v: float, price: float, at: list[float]) -> bool:
        """One row further; price is the close before, at holds the closes of the two lows. True if the peak is broken through and the
        close of the second low lies beyond that of the first."""
        y = self.d * v
        if self.stage == "falling":
            if y < self.low:
                self.low = y
            else:
                at[0], self.stage = price, "turned"
        elif self.stage == "turned":
            if y > self.zone:
                self.peak, self.stage = y, "climbing"
        elif self.stage == "climbing":
            if y > self.peak:
                self.peak = y
            else:
                self.dip, self.stage = y, "dip"
        elif self.stage == "dip":
            if y <= self.dip:
                self.dip = y
            else:
                at[1], self.stage = price, "ready"
        elif y > self.peak:
            if self.d * (at[0] - at[1]) > 0:
                return True
            self.peak, self.stage = y, "climbing"
        elif y < self.dip:
            self.dip, self.stage = y, "dip"
        return False


def _swing_divergences(x: list[float], close: list[float], lo: float, hi: float) -> Iterator[Event]:
    """One search at a time. A row in either zone begins a new one, but for those that only a search from the upper zone is on: it goes
    on through the lower zone, and begins anew in its own only while it waits to leave it."""
    search: _Swing | None = None
    at = [0.0, 0.0]
    for i, v in enumerate(x):
        if search is not None and search.d < 0:
            if search.stage == "turned" and v >= hi:
                search = _Swing(-1, hi, v)
            elif search.broken(v, close[i - 1], at):
                yield i, BEARISH, "divergence", -1.0
                search = None
            continue
        if search is not None and search.broken(v, close[i - 1], at):
            yield i, BULLISH, "divergence", 1.0
            search = None
        if v >= hi:
            search = _Swing(-1, hi, v)
        elif v <= lo:
            search = _Swing(1, lo, v)


def _ultimate_events(x: list[float], close: list[float], lo: float, hi: float) -> Iterator[Event]:
    yield from _original_divergences(x, close, lo, hi)
    yield from _swing_divergences(x, close, lo, hi)


def ultimate_signals(bars: DataFrame, config: tuple[int, int, int] = (7, 14, 28), lo: float = 30.0, hi: float = 70.0) -> DataFrame:
    """The first signal of each row: divergences of the close from the oscillator, by two searches."""

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        x, c = _v(p, "ultimate", "close")
        seen: set[int] = set()
        for e in _ultimate_events(x, c, lo, hi):
            if e[0] not in seen:
                seen.add(e[0])
                yield e

    return signals(ultimate(bars, config), machines, "ultimate", "close")


# --- clusters ------------------------------------------------------------------------------------------------------------------------

STOCHASTICS = {"fast": (10, 3, 3), "medium": (14, 3, 3), "slow": (20, 5, 5)}
ULTIMATES = {"fast": (4, 8, 16), "medium": (7, 14, 28), "slow": (10, 20, 40)}
RSIS = {"fast": 8, "medium": 14, "slow": 20}
CLUSTERS = {
    "full_stochastic": [("stochastic", s) for s in STOCHASTICS], "ultimate": [("ultimate", s) for s in ULTIMATES], "rsi": [("rsi", s) for s in RSIS],
    "all": [(k, s) for k in ("stochastic", "ultimate", "rsi") for s in ("fast", "medium", "slow")], "market": [("stochastic", "medium"), ("ultimate", "medium"), ("rsi", "medium")],
}
BASES = {"stochastic": 2, "rsi": 3, "ultimate": 7}


def _cluster(cell: np.ndarray, events: list[tuple[int, int]], weights: np.ndarray) -> None:
    """Each event in turn: 8 times the weight on a cell that has a value, else 1; neighbours with a value get 5, 3 and 2 times it."""
    n = len(cell)
    for i, sign in events:
        w = weights[i]
        cell[i] += sign * (8.0 * w if cell[i] != 0 else 1.0)
        for k, share in ((1, 5.0), (2, 3.0), (3, 2.0)):
            for j in (i - k, i + k):
                if j < n and cell[j] != 0:  # a row before the first is one from the end
                    cell[j] += sign * share * w


def cluster_oscillators(bars: DataFrame, function: str = "all") -> DataFrame:
    """bars plus clustered: events of several oscillators piled up, order-dependent, with weights by the trend."""
    members = CLUSTERS[function]
    df = bars.withColumn("_raw", trend("close", (28, 56, 84), (0.3, 0.4, 0.3))).withColumn("_trend", scaled_trend("_raw"))
    for kind, speed in members:
        if kind == "stochastic":
            df = stochastic(df, *STOCHASTICS[speed]).withColumnsRenamed({c: f"_st_{speed}_{c}" for c in ("fast_k", "smooth_k", "slow_d")})
        elif kind == "ultimate":
            df = ultimate(df, (5, 10, 20) if function == "all" and speed == "fast" else ULTIMATES[speed]).withColumnRenamed("ultimate", f"_uo_{speed}")
        else:
            df = rsi_thresholds(df, RSIS[speed]).withColumnsRenamed({c: f"_rsi_{speed}_{c}" for c in ("rsi", "oversold", "overbought")})

    def piled(p: pd.DataFrame) -> np.ndarray:
        cell, close = np.zeros(len(p)), p["close"].tolist()
        calm = (p["_trend"].abs() <= 0.1).to_numpy()
        for kind, speed in members:
            if kind == "stochastic":
                f, s, d = _v(p, *[f"_st_{speed}_{c}" for c in ("fast_k", "smooth_k", "slow_d")])
                found = [*_zone_crossings(f, s, ""), *_zone_crossings(s, d, ""), *_zone_divergences(s, close, "")]
            elif kind == "ultimate":
                found = list({e[0]: e for e in reversed(list(_ultimate_events(p[f"_uo_{speed}"].tolist(), close, 30.0, 70.0)))}.values())[::-1]
            else:
                x, lo, hi = _v(p, *[f"_rsi_{speed}_{c}" for c in ("rsi", "oversold", "overbought")])
                found = [*_rejections(x, lo, hi), *_rsi_divergences(x, close, lo, hi)]
            base = BASES[kind]
            whole_weight = {"fast": base // 2, "medium": base, "slow": -(-base // 2)}[speed]
            more = calm if kind == "stochastic" else ~calm if kind == "rsi" else np.zeros(len(p), bool)
            _cluster(cell, [(e[0], 1 if e[1] == BULLISH else -1) for e in found], whole_weight + more.astype(float))
        return cell

    out = with_recurrences(df, clustered=piled)
    return out.select(*bars.columns, "clustered")


def cluster_dates(bars: DataFrame, function: str = "all", least: float = 0.0) -> DataFrame:
    """The rows where events pile up to something other than 0, and to least or more either way: symbol, i, dt, close, clustered."""
    return cluster_oscillators(bars, function).filter((F.col("clustered") != 0) & (F.abs("clustered") >= least)).select("symbol", "i", "dt", "close", "clustered")


def cluster_metric(bars: DataFrame, function: str = "all") -> DataFrame:
    """cluster_oscillators plus metric: spread, averaged and scaled."""
    return smooth_metric(cluster_oscillators(bars, function), "clustered", SPREADS["cluster"])


def cluster_signals(bars: DataFrame, function: str = "all") -> DataFrame:
    """Averaged clusters beyond the 90th or 10th percentile of those that aren't 0."""
    df = with_ema(cluster_oscillators(bars, function), _e=("clustered", 3)).withColumn("_x", F.when(F.col("_e") != 0, F.col("_e")))
    df = df.withColumns({"_top": F.percentile("_x", 0.9).over(whole()), "_low": F.percentile("_x", 0.1).over(whole())})
    kind = F.when(F.col("_x") > F.col("_top"), BULLISH).when(F.col("_x") < F.col("_low"), BEARISH)
    return signal_rows(df, kind, neat("_x", 2), F.col("_x"))


# --- MACD ----------------------------------------------------------------------------------------------------------------------------


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, line: int = 9) -> DataFrame:
    """bars plus macd (0 for the first rows), signal_line and bar."""

    def value(p: pd.DataFrame) -> np.ndarray:
        x = p["close"].to_numpy()
        out = ema(x, fast) - ema(x, slow)
        out[: min(slow, len(out))] = 0.0
        return out

    df = with_recurrences(bars, macd=value, signal_line=lambda p: ema(np.asarray(p["macd"], float), line))
    return df.withColumn("bar", F.col("macd") - F.col("signal_line"))


def _macd_divergences(m: list[float], close: list[float], first: int) -> Iterator[Event]:
    """Two lows below zero of which the second is higher while the close is lower (two peaks above it, the other way round).

    Each row goes to the search for lows first and then to that for peaks, which may begin with what the first has just left.
    """
    d = step = 0
    v0 = v1 = p0 = p1 = 0.0
    for i in range(first, len(m)):
        v, before = m[i], close[i - 1]
        for side in (1, -1):
            if d == 0 and side * v < 0:
                d, step, v0 = side, 1, v
            elif d != side:
                continue
            elif step == 1 and side * (v - v0) < 0:
                v0 = v
            elif step == 1:
                p0, v1, step = before, v, 2
            elif step == 2 and side * (v - v1) <= 0:
                step = 3
            elif step == 2 and side * v > 0:
                d, step, v0 = -side, 1, v
            elif step == 2:
                v1 = v
            elif step == 3 and side * (v - v1) > 0:
                step, p1 = 4, before
            elif step == 3:
                v1, step = v, 1 if side * (v - v0) <= 0 else 3
            elif side * (v - v1) < 0:
                step = 3
            elif side * (p1 - p0) < 0 and v0 < v1:  # v0 < v1 on either side
                d = 0
                yield i, BULLISH if side > 0 else BEARISH, "divergence", float(side)
            else:
                step = 1


def _macd_crossings(m: list[float], bar: list[float], first: int, compat: bool) -> Iterator[Event]:
    state = 0
    for i in range(first, len(m)):  # the line's sign must last for a second row
        now = 1 if m[i] > 0 else -1 if m[i] < 0 else 0
        if now and now != (1 if state > 0 else -1 if state < 0 else 0):
            state = now
        elif state in (1, -1):
            yield i, BULLISH if state > 0 else BEARISH, "zero crossover", float(state)
            state *= 2
    held = 0
    for i in range(first, len(bar)):
        now = 1 if bar[i] > 0 else -1 if bar[i] < 0 else 0
        if now and (held == 0 or (now != held if not compat else held == -1 or now != held)):
            up = now > 0 if not compat or held >= 0 else True
            yield i, BULLISH if up else BEARISH, "bar crossover", 1.0 if up else -1.0
            held = 1 if up else -1


def macd_signals(bars: DataFrame, slow: int = 26, compat: bool = False) -> DataFrame:
    """Divergences, zero crossings of the line, and crossings of the bars. With compat a negative bar after a bearish one counts as
    bullish again."""

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        m, b, c = _v(p.fillna(0.0), "macd", "bar", "close")
        yield from _macd_divergences(m, c, slow)
        yield from _macd_crossings(m, b, slow, compat)

    return signals(macd(bars), machines, "macd", "bar", "close")


def macd_metric(bars: DataFrame) -> DataFrame:
    """macd plus metric: divergences over half of the bars' range added to the bars, averaged and scaled."""
    events = signals(macd(bars), lambda p: _macd_divergences(*_v(p.fillna(0.0), "macd", "close"), 26), "macd", "close")
    df = impulses(macd(bars), events).withColumn("_half", F.max(F.abs("bar")).over(whole()) / 2.0).withColumn("_x", F.col("impulse") * F.col("_half"))
    df = df.withColumn("_bars", F.col("bar") + spread("_x", SPREADS["macd"]))
    return with_ema(df, _e=("_bars", 7)).withColumn("metric", over_largest("_e")).drop("_half", "_x", "_bars", "_e", "impulse")


def sign_runs(df: DataFrame, x: str) -> DataFrame:
    """df plus run_start, run_end and run_rows: the rows around each one without a value of the other sign.

    A row at 0 breaks no run, and its own run is that of a value below 0.
    """
    up, i = F.col(x) > 0, F.col("i")
    before, after = rows(Window.unboundedPreceding, 0), rows(0, Window.unboundedFollowing)
    below, above = F.when(F.col(x) < 0, i), F.when(F.col(x) > 0, i)
    start = F.coalesce(F.when(up, F.max(below).over(before)).otherwise(F.max(above).over(before)), F.lit(-1)) + 1
    end = F.coalesce(F.when(up, F.min(below).over(after)).otherwise(F.min(above).over(after)), F.col("n")) - 1
    return df.withColumns({"run_start": start, "run_end": end}).withColumn("run_rows", F.col("run_end") - F.col("run_start") + 1)


# How much of a factor depends on the length of a run, and the factor where no run came before.
FACTORS, NO_RUN_BEFORE = {"signal": 0.25, "score": 0.1, "state": 0.5}, 1.25


def macd_runs(bars: DataFrame, kind: str = "state") -> DataFrame:
    """macd with its runs of one sign, group_value (percent of the run's largest value), and factor, which is the smaller the longer the
    run of two rows ago is against the one that came before it."""
    df = sign_runs(macd(bars), "macd")
    df = df.withColumn("_top", F.max(F.abs("macd")).over(Window.partitionBy("symbol", F.col("macd") > 0, "run_start")))
    df = df.withColumns({"group_value": F.coalesce(ratio("macd", "_top") * 100.0, F.lit(0.0)), "_rows": lag("run_rows", 2), "_at": lag("run_start", 2) - 2})
    earlier = df.select("symbol", F.col("i").alias("_at"), F.col("run_rows").alias("_before"))
    df = df.join(earlier, ["symbol", "_at"], "left")
    share = FACTORS[kind]
    factor = F.lit(1.0 + share) - F.col("_rows") / F.greatest("_rows", "_before") * share
    known = (F.col("i") > 2) & (F.col("_at") > 0)
    return df.withColumn("factor", F.when(known, factor).otherwise(NO_RUN_BEFORE)).drop("_rows", "_at", "_before")


def macd_statistics(bars: DataFrame, compat: bool = False) -> DataFrame:
    """How each symbol's line stands at its last row.

    period_value: in percent of its largest; group_value: of its run's largest; change: from its average of three rows, in percent of
    the run's largest; current_trend: against the row before; group_trend: against the average of three rows within the run, where it
    is long enough (compat: of runs above 0 alone); state: crossover within three rows, else strongly or weakly by group_value over
    factor, beyond 70.
    """
    df = with_ema(macd_runs(bars), _e=("macd", 3)).withColumns({"_all": F.max(F.abs("macd")).over(whole()), "_last": F.col("i") == F.col("n") - 1, "_m1": lag("macd"), "_m3": lag("macd", 3)})
    up = F.max(F.when(F.col("_last"), F.col("macd") > 0)).over(whole())
    other = F.max(F.when(~F.col("_last") & ((F.col("macd") > 0) != up), F.col("i"))).over(whole())
    within = df.withColumn("_from", F.coalesce(other, F.lit(0))).filter("i >= _from").groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "macd"))), lambda r: r["macd"]).alias("_run"))
    at = lambda k: F.get("_run", F.lit(k))
    average = F.when(F.size("_run") > 6, F.aggregate(F.slice("_run", 4, F.greatest(F.size("_run"), F.lit(1))), (at(0) + at(1) + at(2)) / 3.0, lambda e, v: e * 0.5 + v * 0.5))
    last = df.filter("_last").join(within, "symbol")
    way = lambda c: F.when(c, "rising").otherwise("falling")
    m, strength = F.col("macd"), F.col("group_value") / F.col("factor")
    crossed = F.when((m > 0) & (F.col("_m3") < 0), "crossover_bullish").when((m < 0) & (F.col("_m3") > 0), "crossover_bearish")
    state = F.coalesce(crossed, F.concat(F.when(F.abs(strength) > 70, "strongly").otherwise("weakly"), F.when(strength > 0, "_bullish").otherwise("_bearish")))
    told = F.lit(True) if not compat else m > 0
    return last.select(
        "symbol", "macd", (ratio("macd", "_all") * 100.0).alias("period_value"), "group_value", F.coalesce(ratio(m - F.col("_e"), "_top") * 100.0, F.lit(0.0)).alias("change"), "run_start", "run_rows", "factor",
        way(m > F.col("_m1")).alias("current_trend"), F.when(told & average.isNotNull(), way(m > average)).alias("group_trend"), state.alias("state"),
    )


# --- awesome, momentum ---------------------------------------------------------------------------------------------------------------


def awesome(bars: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    """bars plus awesome, medium and long: difference of two averages of mid prices and its averages, scaled together."""
    df = bars.withColumn("_mid", mid_price()).withColumn("_x", F.when(F.col("i") < slow, F.lit(0.0)).otherwise(sma("_mid", fast) - sma("_mid", slow)))
    df = df.withColumns({"_m": sma("_x", 14), "_l": sma("_x", 34)})
    return df.withColumns({"awesome": over_largest("_x", "_m", "_l"), "medium": over_largest("_m", "_x", "_l"), "long": over_largest("_l", "_x", "_m")}).drop("_mid", "_x", "_m", "_l")


def awesome_trigger() -> Column:
    """1 where signal, medium and long are positive and in order, -1 mirrored, else 0."""
    s, m, g = F.col("awesome"), F.col("medium"), F.col("long")
    return F.when((g > 0) & (m > g) & (s > m), 1).when((g < 0) & (m < g) & (s < m), -1).otherwise(0)


def _twin_peaks(x: list[float]) -> Iterator[Event]:
    """A peak, a saddle that stays above zero, and a second peak below the first (upside down below zero). Only the saddle and the
    time after a signal look at zero."""
    d = 1 if x and x[0] > 0 else -1
    step, top = "move", 0.0
    for i in range(1, len(x)):
        v, was = x[i], x[i - 1]
        if step in ("saddle", "done") and d * v < 0:
            d, step = -d, "move"
        elif step == "move" and d * (v - was) < 0:
            top, step = was, "saddle"
        elif step == "saddle" and d * (v - was) > 0:
            step = "again"
        elif step == "again" and d * (v - top) >= 0:
            top, step = v, "move"
        elif step == "again" and d * (v - was) < 0:
            yield i, BEARISH if d > 0 else BULLISH, "twin peaks", -float(d)
            step = "done"


def _saucers(x: list[float]) -> Iterator[Event]:
    d, step = (1 if x and x[0] > 0 else -1), 0
    for i in range(1, len(x)):
        v, was = x[i], x[i - 1]
        if d * v < 0:
            d, step = -d, 0
        elif step == 0:
            if d * (v - was) < 0:
                step = 1
        elif step == 1:
            step = 2 if d * (v - was) < 0 else 0
        elif d * (v - was) > 0:
            yield i, BULLISH if d > 0 else BEARISH, "saucer", float(d)
            step = 0


def zero_crossings(df: DataFrame, x: str, value: str = "zero crossover", score: float = 1.0) -> DataFrame:
    """Signals where x changes its sign; zeros keep the side, the first side is silent."""
    df = df.withColumn("_side", side(x)).withColumn("_was", lag("_side"))
    kind = F.when(F.col("_side") != F.col("_was"), F.when(F.col("_side") > 0, BULLISH).otherwise(BEARISH))
    return signal_rows(df, kind, F.lit(value), F.col("_side") * score)


def awesome_signals(bars: DataFrame) -> DataFrame:
    df = awesome(bars)

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        (x,) = _v(p.fillna(0.0), "awesome")
        yield from _twin_peaks(x)
        yield from _saucers(x)

    return signals(df, machines, "awesome").unionByName(zero_crossings(df, "awesome"))


def awesome_metric(bars: DataFrame) -> DataFrame:
    """awesome plus trigger and metric: scaled impulses added to the series itself."""
    df = impulses(awesome(bars), awesome_signals(bars)).withColumn("_sign", F.signum("impulse")).withColumn("trigger", awesome_trigger())
    df = smooth_metric(df, "_sign", SPREADS["awesome"], "_m")
    return df.withColumn("metric", F.col("_m") + F.col("awesome")).drop("_m", "_sign", "impulse")


def momentum(bars: DataFrame, n: int = 20, line: int = 9) -> DataFrame:
    """bars plus momentum, from the ups and downs of the n - 2 differences before the row, its average, and their order."""
    d = F.col("close") - lag("close")
    df = bars.withColumn("_d", F.coalesce(d, F.lit(0.0))).withColumns({"_u": F.greatest(F.col("_d"), F.lit(0.0)), "_w": F.greatest(-F.col("_d"), F.lit(0.0))})
    up, down = F.sum("_u").over(rows(2 - n, -1)), F.sum("_w").over(rows(2 - n, -1))
    df = df.withColumn("momentum", F.when(F.col("i") < n - 1, F.lit(0.0)).otherwise(ratio(up - down, up + down) * 100.0)).drop("_d", "_u", "_w")
    df = df.withColumn("momentum_line", sma("momentum", line))
    return df.withColumn("compared", F.signum(F.col("momentum") - F.col("momentum_line")))


def zigzag(x: list[float], threshold: float, points: bool = False) -> list[tuple[int, float, int]]:
    """Extrema by reversals of threshold (a share, or points of a hundred): row, value, and 1 for a maximum or -1."""
    out, d, best, at = [], 0, 0.0, 0
    for i, v in enumerate(x):
        if d == 0:
            d, best, at = (1 if v > 0 else -1), v, i
        elif d * (v - best) > 0:
            best, at = v, i
        elif d * (best - v) > (threshold * 100.0 if points else abs(best) * threshold):
            out.append((at, best, d))
            d, best, at = -d, v, i
    return out


def momentum_signals(bars: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Successive peaks (bottoms) of the oscillator that move against the close."""

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        x, c = _v(p.fillna(0.0), "momentum", "close")
        for d in (1, -1):
            found = [e for e in zigzag(x, threshold, points=True) if e[2] == d]
            for (i, v, _), (j, w, _) in zip(found, found[1:], strict=False):
                if d * (w - v) < 0 and d * (c[j] - c[i]) > 0:
                    yield j, BEARISH if d > 0 else BULLISH, "divergence", -float(d)

    return signals(momentum(bars), machines, "momentum", "close")


def momentum_metric(bars: DataFrame) -> DataFrame:
    """momentum plus metric and change (over five rows)."""
    df = impulses(momentum(bars), momentum_signals(bars)).withColumn("_x", spread("impulse", SPREADS["momentum"])).withColumns({"_a": over_largest("_x"), "_b": over_largest("momentum")})
    df = df.withColumn("metric", F.col("_a") + F.col("_b")).drop("_x", "_a", "_b", "impulse")
    return df.withColumn("change", F.coalesce(F.col("metric") - lag("metric", 5), F.lit(0.0)))


# --- rate of change, know sure thing, commodity channel -----------------------------------------------------------------------------

ROC_WEIGHTS = {10: 0.65, 20: 1.0, 40: 0.4}


def roc_value(n: int, x: str = "close") -> Column:
    return F.when(F.col("i") < n, F.lit(0.0)).otherwise((ratio(x, lag(x, n)) - 1.0) * 100.0)


def rate_of_change(bars: DataFrame, periods: tuple[int, ...] = (10, 20, 40)) -> DataFrame:
    return bars.withColumns({f"roc_{n}": roc_value(n) for n in periods})


def _leaves_zone(x: list[float], top: float, low: float, what: str, score: float) -> Iterator[Event]:
    zone = 0
    for i, v in enumerate(x):
        if zone == 0:
            zone = -1 if v < low else 1 if v > top else 0
        elif zone > 0 and v < top:
            zone = 0
            yield i, BEARISH, f"overbought crossover {what}", -score
        elif zone < 0 and v > low:
            zone = 0
            yield i, BULLISH, f"oversold crossover {what}", score


def roc_signals(bars: DataFrame, weights: dict[int, float] = ROC_WEIGHTS) -> DataFrame:
    """Zero crossings, and exits from beyond the 90th and 10th percentiles, for each period."""
    df = rate_of_change(bars, tuple(weights))
    df = df.withColumns({f"_{a}{n}": F.percentile(f"roc_{n}", p).over(whole()) for n in weights for a, p in (("top", 0.9), ("low", 0.1))})

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        for n, w in weights.items():
            yield from _leaves_zone(p[f"roc_{n}"].tolist(), p[f"_top{n}"].iloc[0], p[f"_low{n}"].iloc[0], f"{n}d", w)

    out = signals(df, machines, *[f"{a}{n}" for n in weights for a in ("roc_", "_top", "_low")])
    for n, w in weights.items():
        out = out.unionByName(zero_crossings(df, f"roc_{n}", f"zero crossover {n}d", 0.75 * w))
    return out


def roc_metric(bars: DataFrame) -> DataFrame:
    df = with_ema(impulses(rate_of_change(bars), roc_signals(bars)), _e=("impulse", 7))
    return df.withColumn("metric", over_largest("_e")).drop("_e", "impulse")


def know_sure_thing(bars: DataFrame, periods: tuple[int, ...] = (10, 15, 20, 30), averages: tuple[int, ...] = (10, 10, 10, 15), line: int = 9, compat: bool = False) -> DataFrame:
    """bars plus kst, the weighted sum of averaged rates of change, and kst_line. With compat it is 0 throughout."""
    df = bars.withColumns({f"_r{n}": roc_value(n) for n in periods})
    parts = [sma(f"_r{n}", a) * float(k + 1) for k, (n, a) in enumerate(zip(periods, averages, strict=True))]
    df = df.withColumn("kst", F.lit(0.0) if compat else sum(parts[1:], parts[0])).drop(*[f"_r{n}" for n in periods])
    return df.withColumn("kst_line", sma("kst", line))


def kst_signals(bars: DataFrame) -> DataFrame:
    """Crossings of the line, and those within the outer 15 percent on either side."""
    df = know_sure_thing(bars)
    df = df.withColumns({"_top": F.percentile("kst", 0.85).over(whole()), "_low": F.percentile("kst", 0.15).over(whole())})

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        p = p.fillna(0.0)
        x, line = _v(p, "kst", "kst_line")
        top, low, zone, over = p["_top"].iloc[0], p["_low"].iloc[0], 0, 0
        for i, (v, s) in enumerate(zip(x, line, strict=True)):
            if zone == 0:
                zone = 1 if v > top else -1 if v < low else 0
            elif zone > 0 and v < top or zone < 0 and v > low:
                zone = 0
            elif zone > 0 and v < s:
                zone = 0
                yield i, BEARISH, "overbought signal_line crossed", -1.0
            elif zone < 0 and v > s:
                zone = 0
                yield i, BULLISH, "oversold signal_line crossed", 1.0
            now = 1 if v > s else -1 if v < s else 0
            if now and now != over:
                if over:
                    yield i, BULLISH if now > 0 else BEARISH, "signal_line crossover", 0.2 * now
                over = now

    return signals(df, machines, "kst", "kst_line", "_top", "_low")


def commodity_channel(bars: DataFrame, intervals: tuple[int, ...] = (20, 40, 80), constant: float = 0.015) -> DataFrame:
    """bars plus cci_n: typical price less its average, over the mean deviation of the n rows before the row from that average.

    The first n rows take the deviation of row n. A flat stretch has none: null.
    """
    df = bars.withColumn("_tp", typical_price()).withColumns({f"_s{n}": sma("_tp", n) for n in intervals} | {f"_w{n}": F.collect_list("_tp").over(rows(-n, -1)) for n in intervals})

    def deviation(n: int) -> Column:
        return F.aggregate(F.col(f"_w{n}"), F.lit(0.0), lambda a, x: a + F.abs(x - F.col(f"_s{n}"))) / float(n)

    dev = {f"_d{n}": deviation(n) for n in intervals}
    df = df.withColumns(dev).withColumns({f"_m{n}": F.max(F.when(F.col("i") == n, F.col(f"_d{n}"))).over(whole()) for n in intervals})
    out = {f"cci_{n}": ratio(F.col("_tp") - F.col(f"_s{n}"), F.when(F.col("i") < n, F.col(f"_m{n}")).otherwise(F.col(f"_d{n}")) * constant) for n in intervals}
    return df.withColumns(out).drop("_tp", *[f"_{a}{n}" for n in intervals for a in "swdm"])


def _cci_events(x: list[float], n: int) -> Iterator[Event]:
    state = ""
    for i, v in enumerate(x):
        if v != v:
            continue
        if state == "":
            state = "p1" if v > 0 else "n1"
        elif state == "n1":
            if v > 0:
                state = "p1"
            elif v <= -100:
                state = "n2"
                yield i, BEARISH, f"crossover to -100 ({n}d)", -1.0
        elif state == "p1":
            if v < 0:
                state = "n1"
            elif v >= 100:
                state = "p2"
                yield i, BULLISH, f"crossover to +100 ({n}d)", 1.0
        elif state == "p2" and v < 0:
            state = "n1"
            yield i, BEARISH, f"zero crossover ({n}d)", -0.6
        elif state == "n2" and v > 0:
            state = "p1"
            yield i, BULLISH, f"zero crossover ({n}d)", 0.6


def cci_signals(bars: DataFrame, intervals: tuple[int, ...] = (20, 40, 80)) -> DataFrame:
    names = [f"cci_{n}" for n in intervals]
    return signals(commodity_channel(bars, intervals), lambda p: (e for n in intervals for e in _cci_events(p[f"cci_{n}"].tolist(), n)), *names)


def cci_metric(bars: DataFrame, intervals: tuple[int, ...] = (20, 40, 80), compat: bool = False) -> DataFrame:
    """Events plus 0.2 for each period beyond +100 and less 0.2 below -100 (with compat: below +100), averaged and scaled."""
    df = impulses(commodity_channel(bars, intervals), cci_signals(bars, intervals))
    level = sum((F.when(F.col(f"cci_{n}") > 100, 0.2).when(F.col(f"cci_{n}") < (100 if compat else -100), -0.2).otherwise(0.0) for n in intervals), F.col("impulse"))
    df = with_ema(df.withColumn("_x", level), _e=("_x", 7))
    return df.withColumn("metric", over_largest("_e")).drop("_x", "_e", "impulse")


# --- metrics of the oscillators above -----------------------------------------------------------------------------------------------


def stochastic_metric(bars: DataFrame) -> DataFrame:
    return smooth_metric(impulses(stochastic(bars), stochastic_signals(bars)), "impulse", SPREADS["stochastic"]).drop("impulse")


def rsi_metric(bars: DataFrame) -> DataFrame:
    return smooth_metric(impulses(rsi_thresholds(bars), rsi_signals(bars)), "impulse", SPREADS["rsi"]).drop("impulse")


def ultimate_metric(bars: DataFrame) -> DataFrame:
    return smooth_metric(impulses(ultimate(bars), ultimate_signals(bars)), "impulse", SPREADS["ultimate"]).drop("impulse")
