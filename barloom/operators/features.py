"""Chart features: price gaps, extrema, head and shoulders, support and resistance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import BEARISH, BULLISH, by_symbol, lag, ordered, ratio, rows, scaled_trend, trend
from .oscillators import zigzag

GAP = 0.0075
#: Prices within this share of each other belong together; and merged lines.
NEAR, MERGED, NEAREST = 0.007, 0.011, 7


def price_gaps(bars: DataFrame, threshold: float = GAP) -> DataFrame:
    """Rows whose range lies above (up) or below (down) that of the row before by more than threshold, and the difference."""
    high, low = lag("high"), lag("low")
    df = bars.withColumns({"_h": high, "_l": low})
    direction = F.when(F.col("_h") < F.col("low") * (1 - threshold), "up").when(F.col("high") < F.col("_l") * (1 - threshold), "down")
    difference = F.when(direction == "up", F.col("high") - F.col("_h")).otherwise(F.col("low") - F.col("_l"))
    return df.withColumns({"direction": direction, "difference": difference}).drop("_h", "_l").filter("direction is not null")


def gap_trends(bars: DataFrame, periods: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """price_gaps with the scaled trend of each period at the gap; all of them share the bars' one window."""
    df = bars.withColumns({f"_t{p}": trend("close", (p,), (1.0,)) for p in periods}).withColumns({f"trend_{p}": scaled_trend(f"_t{p}") for p in periods})
    return price_gaps(df.drop(*[f"_t{p}" for p in periods]))


def zigzag_extrema(bars: DataFrame, x: str = "close", threshold: float = 0.05, points: bool = False) -> DataFrame:
    """Extrema by reversals of more than threshold."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = zigzag(p[x].tolist(), threshold, points)
        return pd.DataFrame({"symbol": p["symbol"].iloc[:1].repeat(len(found)).to_numpy(), "i": [e[0] for e in found], "value": [float(e[1]) for e in found], "kind": ["max" if e[2] > 0 else "min" for e in found]})

    return by_symbol(bars.select("symbol", "i", x), run, "symbol string, i long, value double, kind string")


def filtered_extrema(df: DataFrame, x: str) -> DataFrame:
    """df plus kind: max or min where the direction of x turns in the next row. A first step that isn't up counts as down; level
    steps keep the direction."""
    step = F.when(F.col("i") == 0, F.lit(None)).otherwise(F.signum(F.col(x) - lag(x)))
    df = df.withColumn("_s", F.when((F.col("i") == 1) & (step == 0), -1.0).otherwise(F.when(step != 0, step)))
    df = df.withColumn("_d", F.last("_s", ignorenulls=True).over(rows(Window.unboundedPreceding, 0))).withColumn("_n", F.lead("_d").over(ordered()))
    return df.withColumn("kind", F.when((F.col("_d") > 0) & (F.col("_n") < 0), "max").when((F.col("_d") < 0) & (F.col("_n") > 0), "min")).drop("_s", "_d", "_n")


def _averaged(x: np.ndarray, size: int, strength: float | None) -> np.ndarray:
    """Centred average of size rows, exponential if it has a strength; ends pass through. Nothing for a series of size + 3 rows or
    fewer."""
    half, out = size // 2, x.copy()
    if size >= len(x) - 3:
        return out[:0]
    if half:
        total = np.lib.stride_tricks.sliding_window_view(x, 2 * half).sum(1)[: len(x) - 2 * half]
        inner = x[half : len(x) - half]
        weight = 0.0 if strength is None else min(strength / (size + 1), 1.0)
        out[half : len(x) - half] = total / (2 * half) if strength is None else inner * weight + (total - inner) / (2 * half - 1) * (1 - weight)
    return out


def _turns(x: np.ndarray) -> list[tuple[int, bool]]:
    """Places after which x turns, and whether they are maxima. A first step that isn't up counts as down; level steps keep the
    direction."""
    step = np.sign(np.diff(x))
    if not len(step):
        return []
    step[0] = 1 if step[0] > 0 else -1
    last = np.maximum.accumulate(np.where(step != 0, np.arange(len(step)), 0))
    way = step[last]
    return [(int(k) + 1, bool(way[k] > 0)) for k in np.flatnonzero(way[1:] != way[:-1])]


EXTREMA = "symbol string, size long, seq long, i long, value double, kind string, volume double"


def extrema_of(bars: DataFrame, sizes: dict[int, float | None]) -> DataFrame:
    """Extrema of the closes found through centred averages, all sizes (and their strengths) in one pass over each symbol.

    Around each turn of an average the highest (lowest) close within size / 2 rows counts, the first of equal ones; with size 0 or 1
    the closes' own turns. seq is the order of a kind's turns; one close may come up several times.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        close, volume, out = p["close"].to_numpy(float), p["volume"].to_numpy(float), []
        for size, strength in sizes.items():
            half = size // 2
            for seq, (k, top) in enumerate(_turns(_averaged(close, size, strength))):
                a, b = max(k - half, 0), min(k + max(half, 1), len(close)) if half else k + 1
                at = a + int(np.argmax(close[a:b]) if top else np.argmin(close[a:b]))
                out.append((p["symbol"][0], size, seq, at, close[at], "max" if top else "min", volume[at]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EXTREMA.split(", ")])

    return by_symbol(bars.select("symbol", "i", "close", "volume"), run, EXTREMA)


def without_duplicates(points: DataFrame, method: str = "threshold", threshold: float = 0.01) -> DataFrame:
    """Extrema of a size and kind without repeats, in their order: point drops those at the place of the one before (and at row 0),
    threshold the first one and those within threshold of the value before."""
    w = Window.partitionBy("symbol", "size", "kind").orderBy("seq")
    if method == "point":
        return points.withColumn("_p", F.lag("i").over(w)).filter(F.col("i") != F.coalesce("_p", F.lit(0))).drop("_p")
    was = F.col("_p")
    return points.withColumn("_p", F.lag("value").over(w)).filter((F.col("value") > was * (1 + threshold)) | (F.col("value") < was * (1 - threshold))).drop("_p")


def extrema(bars: DataFrame, size: int) -> DataFrame:
    """Extrema through an average of size rows, each once: symbol, i, value, kind, volume."""
    return extrema_of(bars, {size: 2.0}).select("symbol", "i", "value", "kind", "volume").distinct()


def head_and_shoulders(bars: DataFrame, *sizes: int) -> DataFrame:
    """Six extrema in a row that make a head between two shoulders and end beyond the neckline: filter_size, type, neckline and points.

    Extrema are found through simple centred averages of the sizes; at the same row a minimum comes before a maximum.
    """
    w = Window.partitionBy("symbol", "size").orderBy("i", F.desc("kind"), "seq")
    found = without_duplicates(extrema_of(bars, {n: None for n in sizes or (10,)}))
    p = F.struct("i", "value", "volume")
    df = found.withColumns({f"p{k}": (p if k == 5 else F.lag(p, 5 - k).over(w)) for k in range(6)}).filter("p0 is not null")
    v = {k: F.col(f"p{k}.value") for k in range(6)}
    slope = ratio(v[3] - v[1], (F.col("p3.i") - F.col("p1.i")).cast("double"))
    line = v[1] + slope * (F.col("p5.i") - F.col("p1.i"))
    bear = (v[0] > v[1]) & (v[2] > v[0]) & (v[4] < v[2]) & (v[4] > v[3]) & (F.col("p4.volume") < F.col("p0.volume")) & (v[5] < line)
    bull = (v[0] <= v[1]) & (v[2] < v[0]) & (v[4] > v[2]) & (v[4] < v[3]) & (F.col("p3.volume") > F.col("p0.volume")) & (v[5] > line) & (F.col("p5.volume") > F.col("p3.volume"))
    df = df.withColumns({"type": F.when(bear, BEARISH).when(bull, BULLISH), "slope": slope}).filter("type is not null")
    mean = sum((v[k] for k in range(1, 6)), v[0]) / 6.0
    sd = F.sqrt(sum(((v[k] - mean) * (v[k] - mean) for k in range(1, 6)), (v[0] - mean) * (v[0] - mean)) / 6.0)
    return df.select("symbol", F.col("size").alias("filter_size"), "type", F.col("p0.i").alias("first_i"), F.col("p5.i").alias("last_i"), (F.col("p4.i") - F.col("p0.i")).alias("width"), "slope", (v[1] - F.col("slope") * F.col("p1.i")).alias("intercept"), F.bround(mean, 3).alias("avg"), F.bround(sd, 3).alias("stdev"), F.bround(sd * 100.0 / mean, 3).alias("percent"))


# Filter sizes of the whole search.
SIZES = (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 16, 17, 19, 26, 35, 51)


def all_head_and_shoulders(bars: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    return head_and_shoulders(bars, *sizes)


# --- support and resistance ----------------------------------------------------------------------------------------------------------


def turning_points(bars: DataFrame, timeframes: tuple[int, ...] = (13, 21, 34, 55)) -> DataFrame:
    """The lowest (support) and highest (resistance) close of each block of rows, and its first place in the block."""
    block = F.explode(F.array(*[F.lit(t) for t in timeframes])).alias("timeframe")
    df = bars.select("symbol", "i", "close", block).withColumn("block", F.floor(F.col("i") / F.col("timeframe")))
    ends = df.groupBy("symbol", "timeframe", "block").agg(F.min(F.struct("close", "i")).alias("low"), F.max(F.struct("close", F.negative("i").alias("j"))).alias("high"))
    each = F.explode(F.array(F.struct(F.lit("support").alias("kind"), F.col("low.close").alias("price"), F.col("low.i").alias("i")), F.struct(F.lit("resistance").alias("kind"), F.col("high.close").alias("price"), F.negative("high.j").alias("i")))).alias("x")
    return ends.select("symbol", "timeframe", "block", each).select("symbol", "timeframe", "block", "x.kind", "x.i", "x.price")


def price_clusters(points: DataFrame, near: float = NEAR) -> DataFrame:
    """Points whose prices, in order, are within near of the one before, chained: one row for each chain of two or more. The chain
    with the highest prices is still open and doesn't count."""
    w = Window.partitionBy("symbol", "kind").orderBy("price", "i")
    df = points.select("symbol", "kind", "i", "price").distinct().withColumn("_before", F.lag("price").over(w))
    df = df.withColumn("_new", (F.col("_before").isNull() | (ratio(F.col("price") - F.col("_before"), "_before") >= near)).cast("int"))
    df = df.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", F.max("_chain").over(Window.partitionBy("symbol", "kind")))
    out = df.filter("_chain < _last").groupBy("symbol", "kind", "_chain").agg(F.bround(F.round(F.avg("price"), 6), 2).alias("price"), F.min("i").alias("start"), F.count("*").alias("n_points"))
    return out.filter("n_points > 1").drop("_chain")


def united_levels(levels: DataFrame, share: float = MERGED) -> DataFrame:
    """Levels of either kind that are near each other as one: symbol, price, start.

    In each round every pair of neighbours (in the order of prices) within share of the higher one becomes a level at their mean, in
    whole cents, from the earlier of their starts; rounds go on until no neighbours are near. A level in two pairs is in two means,
    which then are neighbours themselves.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        held = sorted(zip((p["price"] * 100).round().astype(int), p["start"], strict=True))
        while True:
            near = [a[0] > b[0] * (1 - share) for a, b in zip(held, held[1:])]
            if not any(near):
                break
            out: list[tuple[int, int]] = []
            for k, (cents, start) in enumerate(held):
                if k < len(near) and near[k]:
                    twice = cents + held[k + 1][0]
                    out.append((twice // 2 + (twice % 2) * (twice // 2 % 2), min(start, held[k + 1][1])))  # half a cent goes to the even one
                elif k == 0 or not near[k - 1]:
                    out.append((cents, start))
            held = out
        return pd.DataFrame({"symbol": p["symbol"].iloc[0], "price": [c / 100 for c, _ in held], "start": [s for _, s in held]})

    return levels.groupBy("symbol").applyInPandas(run, "symbol string, price double, start long")


def levels_of(bars: DataFrame, timeframes: tuple[int, ...] = (13, 21, 34, 55)) -> DataFrame:
    """The levels of support and resistance of each symbol."""
    return united_levels(price_clusters(turning_points(bars, timeframes)))


def level_analysis(levels: DataFrame, bars: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """Levels against the last close of each symbol, in three lists: the nearest supports below it, the nearest resistances above it,
    and all of them as major, highest first; with the distance in percent and what the level is to the close."""
    closes = bars.filter(F.col("close").isNotNull() & ~F.isnan("close")).groupBy("symbol").agg(F.max_by("close", "i").alias("_last"))
    df = levels.join(closes, "symbol").withColumn("percent", F.bround(ratio(F.col("price") - F.col("_last"), "_last") * 100.0, 3))
    df = df.withColumn("state", F.when(F.col("percent") < 0, "support").otherwise("resistance"))
    lists = F.array_compact(F.array(F.lit("major"), F.when(F.col("price") < F.col("_last"), "support").when(F.col("price") > F.col("_last"), "resistance")))
    df = df.select("*", F.explode(lists).alias("list"))
    far = F.when(F.col("list") == "major", -F.col("price")).otherwise(F.abs(F.col("price") - F.col("_last")))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "list").orderBy(far, "start")))
    return df.filter((F.col("list") == "major") | (F.col("rank") <= nearest)).select("symbol", "list", "rank", "price", "start", "percent", "state")


def support_resistance(bars: DataFrame, timeframes: tuple[int, ...] = (13, 21, 34, 55), nearest: int = NEAREST) -> DataFrame:
    return level_analysis(levels_of(bars, timeframes), bars, nearest)


def nearest_levels(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """For each row the level at or next below its close (support) and the one next above it (resistance).

    An as-of join in the order of prices: levels and closes are one table, and each close sees the last level before it and the first
    one after it, so that rows never meet levels pair by pair.
    """
    both = levels.select("symbol", F.lit(None).cast("long").alias("i"), F.lit(None).cast("date").alias("dt"), F.col("price").alias("_p"), F.col("price").alias("_level")).union(
        bars.select("symbol", "i", "dt", F.col("close").alias("_p"), F.lit(None).cast("double"))
    )
    w = Window.partitionBy("symbol").orderBy("_p", F.col("_level").isNull())  # a level at the very price comes before the close
    below, above = F.last("_level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_level", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumns({"support": below, "resistance": above}).filter("i is not null").select("symbol", "i", "dt", F.col("_p").alias("close"), "support", "resistance")
