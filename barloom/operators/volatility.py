"""Volatility, directional movement, volume and power indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import BEARISH, BULLISH, Event, impulses, lag, over_largest, ratio, rows, side, signal_rows, signals, slope, sma, smooth_metric, spread, trend, whole, with_ema, with_recurrences
from .oscillators import SPREADS
from .trend import typical_price


def average_true_range(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars plus true_range (0 for the first row) and atr, its average; 0 for the first rows."""
    before = lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = bars.withColumn("true_range", F.when(F.col("i") > 0, tr).otherwise(F.lit(0.0)))
    return df.withColumn("atr", F.when(F.col("i") < n - 1, F.lit(0.0)).otherwise(sma("true_range", n)))


def atr_signals(bars: DataFrame) -> DataFrame:
    """Changes of order among the range and its averages over 50 and 200 rows; none for 203 rows or fewer."""
    df = with_ema(average_true_range(bars), _s=("atr", 50), _l=("atr", 200))
    a, s, g = F.col("atr"), F.col("_s"), F.col("_l")
    state = (
        F.when((a > s) & (s > g), "u3").when((a > s) & (a > g), "u2").when((a < s) & (a > g), "u1").when((a > s) & (a < g), "e1").when((a < s) & (s < g), "e3").when((a < s) & (a < g), "e2").otherwise("n")
    )
    df = df.withColumn("_state", state).withColumn("_was", F.coalesce(lag("_state"), F.lit("n"))).filter("_l is not null")
    now, was = F.col("_state"), F.col("_was")
    score = (
        F.when((now == "u3") & (was != "u3"), -1.0).when((now == "e3") & (was != "e3"), 1.0).when((now == "u2") & (was == "e1"), -0.6).when((now == "e2") & (was == "u1"), 0.6)
        .when((now == "u1") & (was == "u3"), 0.2).when((now == "e1") & (was == "e3"), -0.2)
    )
    return signal_rows(df, F.when(score > 0, BULLISH).when(score < 0, BEARISH), F.concat(was, F.lit(" to "), now), score)


def directional_index(bars: DataFrame, n: int = 14, default: float = 20.0) -> DataFrame:
    """bars plus di_plus, di_minus and adx: sums of directional moves that decay by 1 / n, over the average range."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = average_true_range(bars, n)
    df = df.withColumns({"_p": F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)), "_m": F.when((down >= up) & (down > 0), down).otherwise(F.lit(0.0))})

    def decayed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        if len(x) >= n:
            out[n - 1] = x[:n].sum()
            for i in range(n, len(x)):
                out[i] = out[i - 1] - out[i - 1] / n + x[i]
        return out

    df = with_recurrences(df, _sp=lambda p: decayed(p["_p"].to_numpy()), _sm=lambda p: decayed(p["_m"].to_numpy()))
    later = F.col("i") >= n
    df = df.withColumns({"di_plus": F.when(later, ratio("_sp", "atr") * 100.0).otherwise(F.lit(0.0)), "di_minus": F.when(later, ratio("_sm", "atr") * 100.0).otherwise(F.lit(0.0))})
    df = df.withColumn("_dx", F.when(later, F.coalesce(ratio(F.abs(F.col("di_plus") - F.col("di_minus")), F.col("di_plus") + F.col("di_minus")) * 100.0, F.lit(0.0))).otherwise(F.lit(0.0)))

    def averaged(p: pd.DataFrame) -> np.ndarray:
        dx, out = p["_dx"].to_numpy(), np.full(len(p), default)
        if len(out) >= n:
            out[n - 1] = dx[:n].sum() / n
            for i in range(n, len(out)):
                out[i] = (out[i - 1] * 13 + dx[i]) / n
        return out

    return with_recurrences(df, adx=averaged).drop("_p", "_m", "_sp", "_sm", "_dx")


def adx_signals(bars: DataFrame, levels: tuple[float, float, float] = (20.0, 25.0, 40.0)) -> DataFrame:
    """Crossings of the levels for no trend, a strong and a high one, signed by the slope of the last 14 rows."""
    df = directional_index(bars).withColumn("_up", trend("close", (14,), (1.0,)) > 0).withColumn("_was", lag("adx"))
    none, strong, high = levels
    x, was = F.col("adx"), F.col("_was")
    what = F.when((was < strong) & (x >= strong), "strong trend").when((was < none) & (x >= none), "trend begins").when((was > high) & (x <= high), "high trend fades").when((was > none) & (x <= none), "trend ends")
    size = F.when(what == "strong trend", 1.0).when(what == "trend begins", 0.6).when(what == "high trend fades", -0.6).otherwise(-0.2)
    score = size * F.when(F.col("_up"), 1.0).otherwise(-1.0)
    return signal_rows(df, F.when(what.isNotNull(), F.when(score > 0, BULLISH).otherwise(BEARISH)), what, score)


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """bars plus obv: volume added on rising closes and taken away on falling ones."""
    move = F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume")
    return bars.withColumn("_m", move).withColumn("obv", F.sum("_m").over(rows(Window.unboundedPreceding, 0))).drop("_m")


def obv_spikes(bars: DataFrame, factor: float = 5.0, average: int = 20) -> DataFrame:
    """obv and spike: its distance from the average where that is more than the largest over factor, else 0."""
    df = on_balance_volume(bars).withColumn("_d", F.col("obv") - sma("obv", average)).withColumn("_top", F.max(F.abs("_d")).over(whole()))
    return df.withColumn("spike", F.when(F.abs("_d") > F.col("_top") / factor, F.col("_d")).otherwise(F.lit(0.0))).drop("_d", "_top")


def obv_signals(bars: DataFrame) -> DataFrame:
    """Crossings of the averages over 10, 20 and 40 rows, with one side carried through all three, and significant spikes."""
    df = on_balance_volume(bars).withColumns({f"_s{n}": sma("obv", n) for n in (10, 20, 40)})

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        x, held = p["obv"].tolist(), 0
        for n in (10, 20, 40):
            for i, (v, s) in enumerate(zip(x, p[f"_s{n}"].tolist(), strict=True)):
                now = 1 if v > s else -1 if v < s else 0
                if now and now != held:
                    if held:
                        yield i, BULLISH if now > 0 else BEARISH, f"obv crossover ({n}d)", float(now)
                    held = now

    spikes = obv_spikes(bars, 2.5).filter("spike > 0")
    return signals(df, machines, "obv", "_s10", "_s20", "_s40").unionByName(signal_rows(spikes, F.lit(BULLISH), F.concat(F.lit("significant spike: "), F.col("spike").cast("long")), F.lit(1.0)))


def demand_index(bars: DataFrame) -> DataFrame:
    """bars plus demand_index: buying over selling pressure with the smaller on top, averaged over 10 rows."""
    two = F.greatest("high", lag("high")) - F.least("low", lag("low"))
    df = bars.withColumn("_v", F.when(F.col("i") > 0, two).otherwise(F.lit(0.0))).withColumn("_a", sma("_v", 10))
    df = df.withColumn("_k", F.coalesce(ratio(F.col("close") * 3.0, "_a"), F.lit(0.0))).withColumn("_p", ratio(F.col("close") - F.col("open"), "open") * F.col("_k"))
    vol = F.col("volume")
    buy = F.when(F.col("_p") == 0, F.lit(0.0)).when(F.col("_p") > 0, vol).otherwise(ratio(vol, "_p"))
    sell = F.when(F.col("_p") == 0, F.lit(0.0)).when(F.col("_p") > 0, ratio(vol, "_p")).otherwise(vol)
    df = df.withColumns({"_b": buy, "_s": sell}).withColumn("_x", F.coalesce(F.when(F.abs("_b") > F.abs("_s"), ratio("_s", "_b")).otherwise(ratio("_b", "_s")), F.lit(0.0)))
    return with_ema(df, demand_index=("_x", 10)).drop("_v", "_a", "_k", "_p", "_b", "_s", "_x")


def demand_signals(bars: DataFrame, windows: tuple[int, ...] = (3, 4, 5, 7, 10), zones: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Zero crossings, crossings of index and close over their averages in opposite directions, and zone divergences."""
    df = demand_index(bars).withColumns({f"_{a}{w}": sma(x, w) for a, x in (("d", "demand_index"), ("c", "close")) for w in windows})

    def turns(x: list[float], line: list[float]) -> list[int]:
        out, held = [0] * len(x), None
        for i, (v, s) in enumerate(zip(x, line, strict=True)):
            if held is None:
                held = 1 if v > s else -1
            elif held * (v - s) < 0:
                held = -held
                out[i] = held
        return out

    def machines(p: pd.DataFrame) -> Iterator[Event]:
        p = p.fillna(0.0)
        x, c = p["demand_index"].tolist(), p["close"].tolist()
        for i, t in enumerate(turns(x, [0.0] * len(x))):
            if t:
                yield i, BULLISH if t > 0 else BEARISH, "zero crossover", float(t)
        for w in windows:
            for i, (a, b) in enumerate(zip(turns(x, p[f"_d{w}"].tolist()), turns(c, p[f"_c{w}"].tolist()), strict=True)):
                if a * b < 0:
                    yield i, BULLISH if a > 0 else BEARISH, f"dual-signal-line {w}d divergence", float(a)
        for w in zones:
            away = (p["close"] - p[f"_c{w}"]).tolist()
            q = away[0] if away else 0.0
            for i, t in enumerate(turns(x, p[f"_d{w}"].tolist())):
                if t:
                    if t * q > 0 and t * away[i] > 0:
                        yield i, BEARISH if t > 0 else BULLISH, f"signal-line zone {w}d divergence", -float(t)
                    q = away[i]

    return signals(df, machines, "demand_index", "close", *[f"_{a}{w}" for a in "dc" for w in windows])


def demand_metric(bars: DataFrame) -> DataFrame:
    """demand_index plus metric. An event's own row is set, its neighbours are added to, in the order of the events."""
    events = demand_signals(bars).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("i", "value", "score"))).alias("_events"))
    df = demand_index(bars).join(events, "symbol", "left")

    def cells(p: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(p))
        found = p["_events"].iloc[0]
        for e in found if found is not None else ():
            i, s = int(e["i"]), float(e["score"])
            out[i] = s
            for k, w in ((1, 0.85), (2, 0.55), (3, 0.1)):
                for j in (i - k, i + k):
                    if 0 <= j < len(out):
                        out[j] += s * w
        return out

    df = with_ema(with_recurrences(df, _x=cells), _e=("_x", 7))
    return df.withColumn("metric", over_largest("_e")).drop("_events", "_x", "_e")


# --- bands ---------------------------------------------------------------------------------------------------------------------------


def bollinger(bars: DataFrame, n: int = 20, deviations: float = 2.0) -> DataFrame:
    """bars plus middle, upper and lower: the average of typical prices and the deviation of the n rows before; no width before."""
    df = bars.withColumn("_tp", typical_price()).withColumn("middle", sma("_tp", n))
    sd = F.when(F.col("i") < n, F.lit(0.0)).otherwise(F.stddev_pop("_tp").over(rows(-n, -1))) * deviations
    return df.withColumns({"upper": F.col("middle") + sd, "lower": F.col("middle") - sd}).drop("_tp")


def volatility_blend(bars: DataFrame) -> DataFrame:
    """bars plus volatility: two deviations over 50, 100, 250 and 500 rows, blended by how many rows are there, over the price."""
    df = bars.withColumn("_tp", typical_price())
    df = df.withColumns({f"_s{n}": F.when(F.col("i") >= n, F.stddev_pop("_tp").over(rows(-n, -1)) * 2.0).otherwise(F.lit(0.0)) for n in (50, 100, 250, 500)})
    a, b, c, d = (F.col(f"_s{n}") for n in (50, 100, 250, 500))
    blend = F.when(F.col("i") >= 500, a * 0.4 + b * 0.3 + c * 0.2 + d * 0.1).when(F.col("i") >= 250, a * 0.55 + b * 0.3 + c * 0.15).when(F.col("i") >= 100, a * 0.7 + b * 0.3).otherwise(a)
    return df.withColumn("volatility", F.coalesce(ratio(blend, "_tp"), F.lit(0.0))).drop("_tp", "_s50", "_s100", "_s250", "_s500")


def _double_turn(c: list[float], mid: list[float], edge: list[float], first: int, d: int) -> Iterator[Event]:
    """A W at the lower band (d = 1) or an M at the upper one (-1): out, back to the middle, near the band again, and beyond."""
    step, p0, p1, p2 = 0, 0.0, 0.0, 0.0
    for i in range(first, len(c)):
        v, out = c[i], d * (c[i] - edge[i])
        if step == 0:
            if out <= 0 if d > 0 else out < 0:
                step, p0 = 1, v
        elif step == 1:
            if d * (v - p0) < 0:
                p0 = v
            else:
                step = 2
        elif step == 2:
            if d * (v - mid[i]) >= 0:
                step, p1 = 3, v
            elif d * (v - p0) < 0:
                step, p0 = 1, v
        elif step == 3:
            if d * (v - p1) > 0:
                p1 = v
            else:
                step = 4
        elif step == 4:
            if d * (v - p0) < 0:
                step, p2 = 5, v
            elif out <= 0:
                step = 1
            elif d * (v - p1) > 0:
                step, p1 = 3, v
        elif step == 5:
            if d * (v - p2) < 0:
                p2 = v
                step = 1 if out <= 0 else 5
            else:
                step = 6
        elif d * (v - p1) > 0:
            yield i, BULLISH if d > 0 else BEARISH, "W bottom" if d > 0 else "M top", float(d)
            step = 0
        elif d * (v - p2) < 0:
            p2 = v
            step = 1 if out <= 0 else 5


def _band_extremes(c: list[float], mid: list[float], lower: list[float], upper: list[float], first: int) -> Iterator[Event]:
    d = step = 0
    for i in range(first, len(c)):
        v = c[i]
        if d == 0:
            d, step = (1 if v > mid[i] else -1 if v < mid[i] else 0), 1
            continue
        beyond = v >= upper[i] if d > 0 else v <= lower[i]
        name, kind = ("upper", BULLISH) if d > 0 else ("lower", BEARISH)
        if step == 1:
            if beyond:
                step = 2
                yield i, kind, f"{name} band crossover", 0.5 * d
            elif d * (v - mid[i]) < 0:
                d, step = -d, 1
        elif step == 2:
            if beyond:
                yield i, kind, f"{name} band extreme", 0.5 * d
            else:
                step = 3
        elif d * (v - mid[i]) <= 0:
            d, step = -d, 1


def bollinger_signals(bars: DataFrame, n: int = 20) -> DataFrame:
    def machines(p: pd.DataFrame) -> Iterator[Event]:
        p = p.dropna(subset=["middle"])
        c, m, lo, up = (p[x].tolist() for x in ("close", "middle", "lower", "upper"))
        yield from _double_turn(c, m, lo, n, 1)
        yield from _double_turn(c, m, up, n, -1)
        yield from _band_extremes(c, m, lo, up, n)

    return signals(bollinger(bars, n), machines, "close", "middle", "lower", "upper")


def bollinger_metric(bars: DataFrame, n: int = 20) -> DataFrame:
    """bollinger plus metric: events spread; rows within 0.6 of none take the close's place between middle and lower band."""
    df = impulses(bollinger(bars, n), bollinger_signals(bars, n)).withColumn("_x", spread("impulse", SPREADS["bollinger"]))
    place = F.coalesce(F.bround(ratio(F.col("close") - F.col("middle"), F.col("middle") - F.col("lower")), 4), F.lit(0.0))
    df = with_ema(df.withColumn("_y", F.when(F.abs("_x") <= 0.6, place).otherwise(F.col("_x"))), _e=("_y", 7))
    return df.withColumn("metric", over_largest("_e")).drop("_x", "_y", "_e", "impulse")


# --- power ---------------------------------------------------------------------------------------------------------------------------


def bear_bull_power(bars: DataFrame, n: int = 13) -> DataFrame:
    """bars plus average, bulls (high less the exponential average) and bears (low less it)."""
    df = with_ema(bars, average=("close", n))
    return df.withColumns({"bulls": F.col("high") - F.col("average"), "bears": F.col("low") - F.col("average")})


def _power_states(bars: DataFrame, n: int, intervals: tuple[int, ...]) -> DataFrame:
    """One row for each row and interval with the side (1 or -1), step score, and whether the close diverges."""
    df = bear_bull_power(bars, n).withColumns({"_e": slope("average", n - 1), "_db": F.col("bears") - lag("bears"), "_du": F.col("bulls") - lag("bulls"), "_dc": F.col("close") - lag("close")})
    df = df.withColumns({f"_{a}{k}": slope(x, k - 1) for k in intervals for a, x in (("b", "bears"), ("u", "bulls"))})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("interval"), F.col(f"_b{k}").alias("b"), F.col(f"_u{k}").alias("u")) for k in intervals])).alias("x")
    df = df.filter("i > 0").select("symbol", "i", "dt", "_e", "_db", "_du", "_dc", "bulls", "bears", each)
    up = (F.col("_e") > 0) & (F.col("bears") < 0) & (F.col("x.b") > 0)
    down = (F.col("_e") < 0) & (F.col("bulls") > 0) & (F.col("x.u") < 0)
    df = df.withColumn("side", F.when(up, 1).when(down, -1)).filter("side is not null")
    second = F.when(F.col("side") > 0, F.col("_du") > 0).otherwise(F.col("_db") < 0)
    third = second & F.when(F.col("side") > 0, F.col("_dc") < 0).otherwise(F.col("_dc") > 0)
    score = F.col("side") * (F.lit(1.0) + F.when(second, 0.5).otherwise(0.0) + F.when(third, 1.0).otherwise(0.0))
    return df.select("symbol", "i", "dt", F.col("x.interval").alias("interval"), "side", score.alias("score"), third.alias("diverges"))


def bear_bull_signals(bars: DataFrame, n: int = 13, intervals: tuple[int, ...] = (4, 5, 6, 7, 8)) -> DataFrame:
    """Divergences, the first of each row; those of row 0 don't count."""
    first = _power_states(bars, n, intervals).filter("diverges").groupBy("symbol", "i", "dt").agg(F.min(F.struct("interval", "side", "score")).alias("x"))
    kind = F.when(F.col("x.side") > 0, BULLISH).otherwise(BEARISH)
    return signal_rows(first, kind, F.concat(kind, F.lit(" divergence: "), F.col("x.interval"), F.lit("d interval")), F.col("x.score"))


def bear_bull_metric(bars: DataFrame, n: int = 13, intervals: tuple[int, ...] = (4, 5, 6, 7, 8)) -> DataFrame:
    df = impulses(bear_bull_power(bars, n), _power_states(bars, n, intervals))
    return smooth_metric(df, "impulse", SPREADS["bear_bull"]).drop("impulse")


def total_power(bars: DataFrame, lookback: int = 45, powerback: int = 10) -> DataFrame:
    """bars plus bulls, bears and total in percent: in how many rows the high was above, the low below, the exponential average."""
    df = with_ema(bars, _e=("close", powerback))
    df = df.withColumns({"_u": F.when(F.col("high") > F.col("_e"), 1.0).otherwise(0.0), "_d": F.when(F.col("low") < F.col("_e"), 1.0).otherwise(0.0)})
    held = {name: F.when(F.col("i") < lookback - 1, F.sum(x).over(rows(Window.unboundedPreceding, 0))).otherwise(F.sum(x).over(rows(1 - lookback, -1))) * 100.0 / float(lookback) for name, x in (("bulls", "_u"), ("bears", "_d"))}
    df = df.withColumns(held)
    return df.withColumn("total", F.abs(F.col("bulls") - F.col("bears"))).drop("_e", "_u", "_d")


def total_power_signals(bars: DataFrame, level: float = 72.0) -> DataFrame:
    def machines(p: pd.DataFrame) -> Iterator[Event]:
        bulls, bears, total = (p[c].tolist() for c in ("bulls", "bears", "total"))
        on_top, above = (1 if bulls and bulls[0] > bears[0] else -1), 0
        for i, (u, d, t) in enumerate(zip(bulls, bears, total, strict=True)):
            if t >= 99 and u >= 99:
                yield i, BULLISH, "full bullish signal: 100%", 3.0
            if t >= 99 and d >= 99:
                yield i, BEARISH, "full bearish signal: 100%", -3.0
            if on_top * (d - u) > 0:  # both directions score -1
                on_top = -on_top
                yield i, BULLISH if on_top > 0 else BEARISH, "bear-bull crossover", -1.0
            above = -1 if t > d else 1 if t > u else above
            if above and (u if above > 0 else d) > t:
                yield i, BULLISH if above > 0 else BEARISH, "bull-total crossover" if above > 0 else "bear-total crossover", float(above)
                above = 0
            if i and bulls[i - 1] < level < u:
                yield i, BULLISH, "bull-adjustment level crossover", 1.0
            if i and bears[i - 1] < level < d:
                yield i, BEARISH, "bear-adjustment level crossover", -1.0

    return signals(total_power(bars), machines, "bulls", "bears", "total")


def total_power_metric(bars: DataFrame) -> DataFrame:
    return smooth_metric(impulses(total_power(bars), total_power_signals(bars)), "impulse", SPREADS["total_power"]).drop("impulse")


def zone_islands(df: DataFrame, x: str) -> DataFrame:
    """Runs of rows of one sign of x: symbol, sign, first and last row, length and extreme."""
    df = df.withColumn("_side", side(x)).withColumn("_new", (F.col("_side") != F.coalesce(lag("_side"), F.lit(0))).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(rows(Window.unboundedPreceding, 0))).filter("_side is not null")
    return df.groupBy("symbol", F.col("_run").alias("run"), F.col("_side").alias("sign")).agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n_rows"), F.max(F.abs(x)).alias("extreme"))

