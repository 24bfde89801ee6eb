"""Trend lines: along the extrema of blocks of rows and along the outer rows of regressions, lines that are alike as one, and how
closes stand to them.

A line has symbol, slope and intercept over i, and the rows start_i to end_i where it counts. Fits that a later fit depends on go
through one pass over each symbol; everything that asks how rows stand to lines is joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import by_symbol, by_symbol_with
from .features import extrema_of, without_duplicates

LINES = "symbol string, term string, slope double, intercept double, start_i long, end_i long, start_dt date, end_dt date, length long, type string, current boolean"
CHANNELS = "symbol string, id long, divisor long, side string, slope double, intercept double, angle double, start_i long, end_i long"
GROUPS = "symbol string, id long, slope double, intercept double, angle double, start_i long, end_i long, n_lines long"
# Names of the windows, longest first; how far closes may be through a line in its block; refits at most.
TERMS, THROUGH, REFITS = ("long", "intermediate", "short", "near"), 0.01, 50
# Parts of the series, shares that a line may be off a close, and the rounds of grouping (degrees).
DIVISORS, NEAR_PART, NEAR_SLIDE, NEAR_GROUP, ROUNDS, LEAST_ROWS = (1, 2, 4, 8), 0.05, 0.1, 0.03, (2.5, 0.2, 0.3), 4
#: A close within this share of a line is on it: lines pass through closes, and sums of floats don't hit them exactly.
ON = 1e-9


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Least-squares slope and intercept of two or more points; what rises by next to nothing is level."""
    dx, mean = x - x.mean(), float(y.mean())
    slope = float((dx * (y - mean)).sum() / (dx * dx).sum())
    slope = 0.0 if abs(slope) * (x[-1] - x[0]) <= ON * abs(mean) else slope
    return slope, float(mean - slope * x.mean())


# --- lines of blocks -----------------------------------------------------------------------------------------------------------------


def _block_line(line: tuple[float, float], sign: int, x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """The line of a block (line: that of its closes) refitted to the points below it, or above it for sign -1, as long as points are
    left and the slope keeps its sign. One point alone has no line."""
    for _ in range(REFITS):
        if not len(x) or sign * line[0] <= 0:
            break
        if len(x) == 1:
            return None
        line = _fit(x, y)
        beyond = sign * (y - (line[0] * x + line[1])) < -ON * np.abs(y)
        x, y = x[beyond], y[beyond]
    return line


def _holds(line: tuple[float, float], close: np.ndarray, start: int, end: int) -> bool:
    """No close of the block but the last lies a percent through the line."""
    y = line[0] * np.arange(start, end - 1) + line[1]
    c = close[start : end - 1]
    return not (c < y * (1 - THROUGH)).any() if line[0] > 0 else not (c > y * (1 + THROUGH)).any()


def _reach(line: tuple[float, float], close: np.ndarray, band: float) -> int:
    """The row after the last one at which the line's next value is within the band around the close; 1 if there is none."""
    x = np.arange(2, len(close) + 1)
    y, c = line[0] * x + line[1], close[1:]
    near = np.flatnonzero((y <= (1 + band) * c) & (y >= (1 - band) * c))
    return int(x[near[-1]]) if len(near) else 1


def trend_lines(bars: DataFrame, sizes: tuple[int, ...] = (4, 8, 16, 32), windows: tuple[float, ...] = (163, 91, 56, 27), volatility: float = 0.06) -> DataFrame:
    """Lines along the minima of rising blocks and the maxima of falling ones.

    Extrema are found through centred averages of the given sizes, each a little stronger than the one before. For each window (rows,
    or a share of the series below 1) the series is cut into whole blocks; a block's line is refitted until no point is beyond it, is
    dropped if closes of the block are through it, and then is carried to the end of the series and back to where it last was within
    volatility of the closes. current: it reaches the last row. A symbol without whole blocks has no line.
    """
    found = without_duplicates(extrema_of(bars, {n: 2.0 + 0.1 * k for k, n in enumerate(sizes)}), "point").select("symbol", "i", "value", "kind").distinct()

    def lines(p: pd.DataFrame, points: pd.DataFrame) -> Iterator[tuple]:
        close, n = p["close"].to_numpy(), len(p)
        points = points.sort_values("i")
        at, value, top = points["i"].to_numpy(float), points["value"].to_numpy(float), (points["kind"] == "max").to_numpy(bool)
        for term, w in zip(TERMS, windows, strict=False):
            window = int(n * w) if w < 1 else int(w)
            for start in range(0, n - window + 1, window) if window > 1 else ():
                end = start + window
                whole = _fit(np.arange(start, end, dtype=float), close[start:end])
                sign = 1 if whole[0] >= 0 else -1
                own = (at >= start) & (at < end) & (top == (sign < 0))
                line = _block_line(whole, sign, at[own], value[own])
                if line and _holds(line, close, start, end) and (stop := _reach(line, close, volatility)) > start + 1:
                    yield term, *line, start, stop - 1, p["dt"][start], p["dt"][stop - 1], stop - start, "bear" if line[0] < 0 else "bull", stop == n

    def run(p: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in LINES.split(", ")]
        out = pd.DataFrame(list(lines(p, points)), columns=names[1:])
        out.insert(0, "symbol", p["symbol"][0])
        return out

    return by_symbol_with(bars.select("symbol", "i", "dt", "close"), found, run, LINES)


# --- closes against lines --------------------------------------------------------------------------------------------------------------


def _along(lines: DataFrame, bars: DataFrame, *keep: str) -> DataFrame:
    """A row for each row of bars that a line covers, with _y, the line's value there: an equi-join on the symbol and the row."""
    rows = lines.select("symbol", *keep, "slope", "intercept", "start_i", F.explode(F.sequence("start_i", "end_i")).alias("i"))
    return rows.join(bars.select("symbol", "i", "dt", "close"), ["symbol", "i"]).withColumn("_y", F.col("slope") * F.col("i") + F.col("intercept"))


def _sides(lines: DataFrame, bars: DataFrame, *keep: str) -> DataFrame:
    """_along with _on (the close is on the line), _above (it is on or above it) and _was (that of the row before)."""
    df = _along(lines, bars, "term", *keep).withColumn("_on", F.abs(F.col("close") - F.col("_y")) <= ON * F.abs("_y"))
    df = df.withColumn("_above", F.col("_on") | (F.col("close") > F.col("_y")))
    return df.withColumn("_was", F.lag("_above").over(Window.partitionBy("symbol", "term", "start_i").orderBy("i")))


def _named(above: Column) -> Column:
    return F.when(above, "above").otherwise("below")


def line_touches(lines: DataFrame, bars: DataFrame) -> DataFrame:
    """Where closes cross each line, with the side that they are on then, or touch it, with the side that they come from.

    A close that comes from below onto the line crosses it and touches it.
    """
    df = _sides(lines, bars).withColumn("_from", F.coalesce("_was", "_above"))
    cross = F.when(F.col("_above") != F.col("_from"), F.struct(F.lit("cross").alias("event"), _named(F.col("_above")).alias("side")))
    touch = F.when(F.col("_on"), F.struct(F.lit("touch").alias("event"), _named(F.col("_from")).alias("side")))
    out = df.select("symbol", "term", "start_i", "i", "dt", "close", F.explode(F.array_compact(F.array(cross, touch))).alias("x"))
    return out.select("symbol", "term", "start_i", "i", "dt", F.col("close").alias("price"), "x.event", "x.side")


def line_periods(lines: DataFrame, bars: DataFrame, compat: bool = False) -> DataFrame:
    """Stretches of rows over which each line is valid (closes above a rising line, below a falling one) or broken.

    With compat a line that closes never cross is valid, even with all of them on its wrong side.
    """
    w = Window.partitionBy("symbol", "term", "start_i").orderBy("i")
    df = _sides(lines, bars, "type").withColumn("_turn", (F.col("_above") != F.coalesce("_was", "_above")).cast("int"))
    df = df.withColumn("period", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if compat:
        df = df.withColumn("_above", F.when(F.max("period").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 0, F.col("type") == "bull").otherwise(F.col("_above")))
    valid = F.first("_above") == (F.first("type") == "bull")
    out = df.groupBy("symbol", "term", "start_i", "period").agg(F.when(valid, "valid").otherwise("broken").alias("state"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    return out.select("symbol", "term", "start_i", "period", "state", "first_i", "last_i", "first_dt", "last_dt")


def line_forecast(lines: DataFrame, bars: DataFrame, ahead: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Each line carried on beyond its end: price so many rows ahead, whether the last close is above or below the first of them, and
    the direction."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "i").alias("_last"))
    price = lambda k: F.bround(F.round(F.col("slope") * (F.col("end_i") + k) + F.col("intercept"), 6), 2)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("ahead"), price(k).alias("price")) for k in ahead])).alias("x")
    state = F.when(F.col("_last") < price(ahead[0]), "Below").otherwise("Above")
    direction = F.when(F.col("slope") < 0, "DOWN").when(F.col("slope") > 0, "UP").otherwise("n/a")
    return lines.join(last, "symbol").select("symbol", "term", "start_i", "end_i", "current", state.alias("state"), direction.alias("direction"), rows).select("symbol", "term", "start_i", "end_i", "current", "x.ahead", "x.price", "state", "direction")


# --- lines of regressions --------------------------------------------------------------------------------------------------------------


def _near(line: tuple[float, float], x: np.ndarray, start: int, end: int, share: float) -> tuple[int, int] | None:
    """First and last row from start to end at which the line is within share of the series; none if it never is."""
    y, s = line[0] * np.arange(start, end + 1) + line[1], x[start : end + 1]
    low, high = np.where(y < 0, (1 + share) * s, (1 - share) * s), np.where(y < 0, (1 - share) * s, (1 + share) * s)
    at = np.flatnonzero((y >= low) & (y <= high))
    return (start + int(at[0]), start + int(at[-1])) if len(at) else None


def _angle(slope: float, scale: float) -> float:
    """Degrees of a line drawn as wide as high; falling lines count on from 180."""
    return float(np.degrees(np.arctan(slope * scale))) + (180.0 if slope < 0 else 0.0)


def _scale(x: np.ndarray) -> float:
    return len(x) / float(x.max() - x.min()) if len(x) and x.max() > x.min() else 0.0


def channel_lines(bars: DataFrame, divisors: tuple[int, ...] = DIVISORS, x: str = "close") -> DataFrame:
    """Lines along the upper and the lower rows of parts of a series, numbered by symbol.

    Parts are the series divided by each divisor (the last one takes the rest), and windows of the same length that move by two rows.
    A part is refitted to the rows beyond its line until four are left; fewer than two have no line. A line counts from the first to
    the last row at which it is near the series: within 5 percent, or 10 for windows that move.
    """

    def lines(v: np.ndarray) -> Iterator[tuple]:
        n, scale = len(v), _scale(v)
        for d in divisors:
            period = n // d
            parts = [(period * k, n if k == d - 1 else period * (k + 1), NEAR_PART) for k in range(d)] + [(k - period, k, NEAR_SLIDE) for k in range(period, n, 2)]
            for a, b, share in parts:
                for side, sign in (("upper", 1), ("lower", -1)):
                    at, y = np.arange(a, b, dtype=float), v[a:b]
                    while len(at) > LEAST_ROWS:
                        slope, intercept = _fit(at, y)
                        beyond = sign * (y - (slope * at + intercept)) > 0
                        at, y = at[beyond], y[beyond]
                    if len(at) > 1 and (span := _near(line := _fit(at, y), v, 0, n - 1, share)):
                        yield d, side, *line, _angle(line[0], scale), *span

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = list(lines(p[x].to_numpy(float)))
        out = pd.DataFrame(found, columns=["divisor", "side", "slope", "intercept", "angle", "start_i", "end_i"])
        out.insert(0, "id", np.arange(len(out)))
        out.insert(0, "symbol", p["symbol"][0])
        return out

    return by_symbol(bars.select("symbol", "i", x), run, CHANNELS)


def _alike(angle: float, intercept: float, other_angle: float, other: float, degrees: float) -> bool:
    """Whether a line whose angle is no smaller belongs to the group that begins with the first."""
    share = degrees / 20.0
    if angle + degrees <= other_angle:
        return False
    return (1 - share) * intercept > (1 + share) * other if intercept < 0 else (1 + share) * intercept > (1 - share) * other


def line_groups(lines: DataFrame, bars: DataFrame, x: str = "close", rounds: tuple[float, ...] = ROUNDS, compat: bool = False) -> DataFrame:
    """Lines that are alike as one, with n_lines, how many they were.

    In each round lines go by angle, and a group takes in lines as long as their angle and their intercept are close to those of its
    first. A group has the mean slope and intercept, and counts over the rows of all its lines from the first to the last at which it
    is within 3 percent of the series, if these are more than four. The described search forgets the last group of each round; compat
    does so.
    """

    def run(p: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        v = p[x].to_numpy(float)
        scale = _scale(v)
        held = [(r.angle, int(r.id), r.slope, r.intercept, int(r.start_i), int(r.end_i), 1) for r in own.itertuples()]
        for degrees in rounds:
            groups: list[list[tuple]] = []
            for line in sorted(held, key=lambda r: r[:2]):
                if groups and _alike(groups[-1][0][0], groups[-1][0][3], line[0], line[3], degrees):
                    groups[-1].append(line)
                else:
                    groups.append([line])
            held = []
            for g in groups[:-1] if compat else groups:
                slope, intercept = float(np.mean([r[2] for r in g])), float(np.mean([r[3] for r in g]))
                span = _near((slope, intercept), v, min(r[4] for r in g), max(r[5] for r in g), NEAR_GROUP)
                if span and span[1] - span[0] + 1 > LEAST_ROWS:
                    held.append((_angle(slope, scale), len(held), slope, intercept, *span, sum(r[6] for r in g)))
        out = pd.DataFrame(held, columns=["angle", "id", "slope", "intercept", "start_i", "end_i", "n_lines"])
        out.insert(0, "symbol", p["symbol"][0])
        return out[[c.split()[0] for c in GROUPS.split(", ")]]

    return by_symbol_with(bars.select("symbol", "i", x), lines, run, GROUPS)


def nearest_lines(lines: DataFrame, bars: DataFrame) -> DataFrame:
    """For each row the nearest line on or above its close and the nearest below it, of those that cover the row: their values, and the
    id of the line; null where there is none."""
    df = _along(lines, bars, "id").withColumn("_d", F.col("_y") - F.col("close"))
    higher = F.col("_d") >= -ON * F.abs("_y")
    above, below = F.when(higher, F.struct("_d", "id", "_y")), F.when(~higher, F.struct((-F.col("_d")).alias("_d"), "id", "_y"))
    near = df.groupBy("symbol", "i").agg(F.min(above).alias("_a"), F.min(below).alias("_b"), F.count("*").alias("n_lines"))
    out = bars.select("symbol", "i", "close").join(near, ["symbol", "i"], "left")
    return out.select("symbol", "i", "close", F.col("_a._y").alias("above"), F.col("_a.id").alias("above_id"), F.col("_b._y").alias("below"), F.col("_b.id").alias("below_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
