"""Building blocks over ordered series: window expressions as columns, and per-symbol recurrences and state machines.

A series table has symbol, i (0-based place of the row in its symbol), n (rows of the symbol) and dt. One symbol has one row for
each calendar period at most, so a symbol's rows are bounded by the calendar however many ticks they were made of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Signals of an operator: place, bullish or bearish, what was seen, and the score that its metrics spread.
SIGNALS = "symbol string, i long, dt date, type string, value string, score double"
BULLISH, BEARISH = "bullish", "bearish"


#: Rows of a stretch.
STRETCH = 1 << 16


def ordered(*within: str) -> WindowSpec:
    return Window.partitionBy("symbol", *within).orderBy("i")


def rows(a: int, b: int, *within: str) -> WindowSpec:
    return ordered(*within).rowsBetween(a, b)


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, k: int = 1, *within: str) -> Column:
    return F.lag(x, k).over(ordered(*within)) if k >= 0 else F.lead(x, -k).over(ordered(*within))


def stretches(df: DataFrame, back: int) -> DataFrame:
    """df in stretches of STRETCH rows of a symbol, numbered in _part: a window by (symbol, _part) holds one of them, however long a symbol is.

    The last back rows of a stretch stand once more ahead of the next one, with _own false, for windows that look back so far.
    """
    own = F.expr(f"i div {STRETCH}")
    parts = F.when(F.col("i") % STRETCH >= STRETCH - back, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == own)


def neat(x: str | Column, digits: int = 4) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def sma(x: str | Column, n: int, *within: str) -> Column:
    """Simple moving average: the value itself before n values are there, null for a symbol of n + 3 rows or fewer."""
    return F.when(F.col("n") > n + 3, F.when(F.col("i") < n - 1, col(x)).otherwise(F.avg(x).over(rows(1 - n, 0, *within))))


def wma(x: str | Column, n: int) -> Column:
    """Linearly weighted average, newest heaviest; the value itself for the first n rows."""
    total = sum((lag(x, k) * float(n - k) for k in range(1, n)), col(x) * float(n))
    return F.when(F.col("i") < n, col(x)).otherwise(total / (n * (n + 1) / 2))


def centred(x: str | Column, n: int, strength: float | None = None) -> Column:
    """Average of the rows from -n/2 to n/2 - 1; ends pass through. With strength the neighbours' mean is blended with the value."""
    half = n // 2
    if half == 0 or (strength is not None and n < 2):
        return col(x)
    inner = (F.col("i") >= half) & (F.col("i") < F.col("n") - half)
    if strength is None:
        return F.when(inner, F.avg(x).over(rows(-half, half - 1))).otherwise(col(x))
    weight = min(strength / (n + 1), 1.0)
    around = (F.sum(x).over(rows(-half, half - 1)) - col(x)) / float(2 * half - 1)
    return F.when(inner, col(x) * weight + around * (1 - weight)).otherwise(col(x))


def slope(x: str | Column, n: int, first: int | None = None) -> Column:
    """Slope of the least-squares line through the rows from -n (or first) to -1; 0 before n rows are there."""
    return F.when(F.col("i") < n, F.lit(0.0)).otherwise(F.regr_slope(col(x), F.col("i").cast("double")).over(rows(-n if first is None else first, -1)))


def trend(x: str | Column, periods: Iterable[float], weights: Iterable[float]) -> Column:
    """Weighted sum of slopes over the last rows, the current one left out."""
    return sum((slope(x, int(p)) * w for p, w in zip(periods, weights, strict=True)), F.lit(0.0))


def scaled_trend(x: str) -> Column:
    """Falling parts over their minimum to -0.35, others over their maximum to 0.35."""
    low, high = F.min(x).over(whole()), F.max(x).over(whole())
    return F.when(F.col(x) < 0, F.col(x) / low * -0.35).when(high > 0, F.col(x) / high * 0.35).otherwise(F.lit(0.0))


def spread(x: str | Column, weights: tuple[float, ...]) -> Column:
    """Impulses spread to three rows on either side: weights for the row itself and distances 1 to 3."""
    out = F.coalesce(col(x), F.lit(0.0)) * weights[0]
    for k in (1, 2, 3):
        out = out + (F.coalesce(lag(x, k), F.lit(0.0)) + F.coalesce(lag(x, -k), F.lit(0.0))) * weights[k]
    return out


def over_largest(x: str, *together: str) -> Column:
    """x over the largest absolute value of the symbol, of x and the columns together; unchanged if all are 0."""
    largest = F.greatest(*[F.max(F.abs(c)).over(whole()) for c in (x, *together)]) if together else F.max(F.abs(x)).over(whole())
    return F.when(largest > 0, F.col(x) / largest).otherwise(F.col(x))


def side(x: str | Column) -> Column:
    """Sign of x, with the last sign before where x is 0; null before the first."""
    return F.last(F.when(col(x) > 0, 1).when(col(x) < 0, -1), ignorenulls=True).over(rows(Window.unboundedPreceding, 0))


# --- recurrences: one pass over each symbol in order ---------------------------------------------------------------------------------


def ema(x: np.ndarray, n: int, factor: float = 2.0) -> np.ndarray:
    """Exponential average seeded with the mean of the first n values, which pass through before; NaN for n + 3 rows or fewer."""
    if n >= len(x) - 3:
        return np.full(len(x), np.nan)
    out, k = np.array(x, float), factor / (n + 1)
    e = out[n - 1] = float(np.mean(out[:n]))
    for j in range(n, len(out)):
        e = out[j] = e * (1 - k) + out[j] * k
    return out


def by_symbol(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over the rows of each symbol in the order of i. What run gives for a symbol may be empty, whatever its column types."""
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table().to_pandas()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf.sort_values("i", kind="stable", ignore_index=True))
        return out if len(out) else none

    return df.groupBy("symbol").applyInPandas(whole, schema)


def by_symbol_with(df: DataFrame, other: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over the rows of each symbol of df in the order of i and the rows of other for it, each sent once."""
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table().to_pandas()

    def whole(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf.sort_values("i", kind="stable", ignore_index=True), more) if len(pdf) else none
        return out if len(out) else none

    apart = other.withColumnRenamed("symbol", "_symbol")  # the two may stem from the same bars
    return df.groupBy("symbol").cogroup(apart.groupBy("_symbol")).applyInPandas(whole, schema)


def with_recurrences(df: DataFrame, **made: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """df plus a double column for each function of a symbol's rows in order; NaN becomes null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        for name, f in made.items():
            pdf[name] = f(pdf)
        return pdf

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` double" for name in made]
    out = by_symbol(df, run, ", ".join(fields))
    return out.withColumns({name: F.nanvl(F.col(name), F.lit(None).cast("double")) for name in made})


class EmaRun:
    """ema() over a symbol whose rows come in pieces: holds the first n values until their mean is known, then one number.

    rows: of the symbol, or n + 4 if there are more.
    """

    def __init__(self, n: int, rows: int, factor: float = 2.0):
        self.n, self.k, self.none, self.first, self.e = n, factor / (n + 1), n >= rows - 3, np.empty(0), None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.none:
            return np.full(len(x), np.nan)
        out = np.array(x, float)
        at = 0
        if self.e is None:
            at = min(self.n - len(self.first), len(out))
            self.first = np.concatenate([self.first, out[:at]])
            if len(self.first) < self.n:
                return out
            self.e = out[at - 1] = float(np.mean(self.first))
        e, k, rest = self.e, self.k, out[at:].tolist()
        for j, v in enumerate(rest):
            e = rest[j] = e * (1 - k) + v * k
        self.e, out[at:] = e, rest
        return out


def with_ema(df: DataFrame, **made: tuple[str, int]) -> DataFrame:
    """df plus exponential averages: name=(column, rows), all in one pass.

    Rows are streamed in the order of (symbol, i), and only a symbol's last averages are carried from one batch to the next, so that a
    worker's memory doesn't grow with the symbol. A symbol's first rows wait until so many are there that it is known to have averages.
    """
    schema = StructType(df.schema.fields + [StructField(name, DoubleType()) for name in made])
    enough = max(n for _, n in made.values()) + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, runs, waiting = None, {}, None
        for batch in chain(batches, [None]):
            now = waiting if batch is None else batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            waiting = None
            if now is None or not now.num_rows:
                continue
            own = now.column("symbol").dictionary_encode("encode")
            names, codes = own.dictionary.to_pylist(), own.indices.to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            follows = len(starts) == 2 and runs and names[codes[0]] == symbol
            if batch is not None and not follows and starts[-1] - starts[-2] < enough:
                starts.pop()
                now, waiting = now.slice(0, starts[-1]), now.slice(starts[-1])
            values = {x: now.column(x).to_numpy(zero_copy_only=False).astype(float) for x, _ in made.values()}
            out = {name: np.empty(now.num_rows) for name in made}
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if not runs or names[codes[a]] != symbol:
                    symbol = names[codes[a]]
                    runs = {name: EmaRun(n, b - a) for name, (_, n) in made.items()}
                for name, (x, _) in made.items():
                    out[name][a:b] = runs[name](values[x][a:b])
            if now.num_rows:
                columns = [pa.array(v, pa.float64(), from_pandas=True) for v in out.values()]
                yield pa.RecordBatch.from_arrays(now.columns + columns, names=schema.names)

    return df.repartition("symbol").sortWithinPartitions("symbol", "i").mapInArrow(run, schema)


Event = tuple[int, str, str, float]


def signals(df: DataFrame, machines: Callable[[pd.DataFrame], Iterator[Event]], *columns: str) -> DataFrame:
    """Signals that state machines emit over each symbol's rows: (row, type, value, score), ordered by symbol and row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        events = list(machines(pdf))
        at = [e[0] for e in events]
        out = pdf[["symbol", "i", "dt"]].iloc[at].reset_index(drop=True)
        return out.assign(type=[e[1] for e in events], value=[e[2] for e in events], score=[float(e[3]) for e in events]).astype({"type": str, "value": str, "score": float})

    return by_symbol(df.select("symbol", "i", "dt", *columns), run, SIGNALS)


def signal_rows(df: DataFrame, kind: Column, value: Column, score: Column | None = None) -> DataFrame:
    """Rows of df where kind isn't null as signals."""
    out = df.select("symbol", F.col("i").cast("long").alias("i"), "dt", kind.alias("type"), value.cast("string").alias("value"), (F.lit(0.0) if score is None else score.cast("double")).alias("score"))
    return out.filter("type is not null")


def impulses(df: DataFrame, events: DataFrame, name: str = "impulse") -> DataFrame:
    """df plus the sum of the scores of the events of each row."""
    sums = events.groupBy("symbol", "i").agg(F.sum("score").alias(name))
    return df.join(sums, ["symbol", "i"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def smooth_metric(df: DataFrame, impulse: str, weights: tuple[float, ...], out: str = "metric", span: int = 7) -> DataFrame:
    """Impulses spread, averaged exponentially, and scaled to -1..1: the score series of most indicators."""
    df = df.withColumn("_spread", spread(impulse, weights))
    df = with_ema(df, _smooth=("_spread", span))
    return df.withColumn(out, over_largest("_smooth")).drop("_spread", "_smooth")
