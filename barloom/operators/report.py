"""Results across indicators: last signals, synopsis, overall metrics, filtered exports, and their files."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import over_largest
from . import candles, oscillators, trend, volatility


def all_signals(named: dict[str, DataFrame]) -> DataFrame:
    """Signals of several indicators with the indicator's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("indicator", F.lit(name)) for name, df in named.items()])


#: The signals of each indicator, by its name.
INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "average": lambda b: trend.crossovers(trend.triple_average(b)),
    "exponential_average": lambda b: trend.crossovers(trend.triple_average(b, (9, 20, 50), "ema"), (9, 20, 50)),
    "swing": trend.swing_signals,
    "parabolic_sar": trend.sar_signals,
    "stochastic": oscillators.stochastic_signals,
    "rsi": oscillators.rsi_signals,
    "ultimate": oscillators.ultimate_signals,
    "macd": oscillators.macd_signals,
    "awesome": oscillators.awesome_signals,
    "momentum": oscillators.momentum_signals,
    "rate_of_change": oscillators.roc_signals,
    "know_sure_thing": oscillators.kst_signals,
    "commodity_channel": oscillators.cci_signals,
    "bear_bull": volatility.bear_bull_signals,
    "total_power": volatility.total_power_signals,
    "bollinger": volatility.bollinger_signals,
    "true_range": volatility.atr_signals,
    "directional": volatility.adx_signals,
    "balance_volume": volatility.obv_signals,
    "demand": volatility.demand_signals,
    "candlesticks": candles.candle_signals,
}


def indicator_signals(bars: DataFrame, names: Iterable[str] = tuple(INDICATORS)) -> DataFrame:
    """One table of the signals of all indicators: symbol, i, dt, type, value, score, indicator.

    The indicators' branches begin with the same bars, whose shuffle Spark makes once and uses again.
    """
    return all_signals({name: INDICATORS[name](bars) for name in names})


def last_signals(found: DataFrame, bars: DataFrame, lookback: int = 10) -> DataFrame:
    """Signals of the last rows of each symbol, with how many rows ago they were."""
    last = bars.groupBy("symbol").agg(F.max("i").alias("last_i"))
    df = found.join(last, "symbol").filter(F.col("i") >= F.col("last_i") - lookback)
    return df.select("symbol", "indicator", "i", "dt", "type", "value", (F.col("last_i") - F.col("i")).alias("days_ago"))


def merged_signals(found: DataFrame, gap: str = "21 days") -> DataFrame:
    """Signals of one type that follow one another within gap as one: their span, how many they were, and of which indicators.

    Session windows over the signals of each symbol and type: a signal more than gap after the one before begins anew.
    """
    session = F.session_window(F.col("dt").cast("timestamp"), gap)
    out = found.groupBy("symbol", "type", session.alias("_s")).agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count("*").alias("n_signals"), F.concat_ws(",", F.array_sort(F.collect_set("indicator"))).alias("indicators"))
    return out.drop("_s")


def overall_metric(metrics: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Sum of score series by symbol and row: oscillators whole, trends a tenth. metrics: name -> (kind, table, column)."""
    parts = [df.select("symbol", "i", (F.col(c) * (1.0 if kind == "oscillator" else 0.1)).alias("x")) for kind, df, c in metrics.values()]
    out = reduce(DataFrame.unionByName, parts).groupBy("symbol", "i").agg(F.sum("x").alias("metric"))
    return out.withColumn("scaled", over_largest("metric"))


def long_series(df: DataFrame, indicator: str, *columns: str) -> DataFrame:
    """Columns of a wide indicator as rows: symbol, i, dt, indicator, component, value."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    return df.select("symbol", "i", "dt", F.lit(indicator).alias("indicator"), cells).select("symbol", "i", "dt", "indicator", "x.component", "x.value")


def synopsis(series: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Last and previous value of each component, with its kind. Trend components with swing or metric in their names count as oscillators."""
    w = Window.partitionBy("symbol", "indicator", "component").orderBy("i")
    df = series.withColumn("_before", F.lag("value").over(w)).groupBy("symbol", "indicator", "component").agg(F.max_by("value", "i").alias("current"), F.max_by("_before", "i").alias("previous"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("indicator")], F.lit("feature"))
    return df.withColumn("kind", F.when((kind == "trend") & F.col("component").rlike("metric|swing"), "oscillator").otherwise(kind))


ALIASES = {"S&P500": "^GSPC", "S&P": "^GSPC", "SP500": "^GSPC", "SPY500": "^GSPC"}


def export_filter(series: DataFrame, keys: str) -> DataFrame:
    """Rows whose symbol or indicator is among the words of keys; of either sort all if none is named. Case doesn't matter."""
    words = [ALIASES.get(k.upper(), k.upper()) for k in keys.split()]
    known = series.select(F.upper("symbol").alias("k"), F.lit("s").alias("sort")).union(series.select(F.upper("indicator"), F.lit("t"))).filter(F.col("k").isin(words or [""])).distinct()
    sorts = {s: [r["k"] for r in known.filter(F.col("sort") == s).collect()] for s in "st"}  # as many rows as words at most
    out = series
    for column, sort in (("symbol", "s"), ("indicator", "t")):
        if sorts[sort]:
            out = out.filter(F.upper(column).isin(sorts[sort]))
    return out


def export_pivot(series: DataFrame, components: list[str]) -> DataFrame:
    """One row for each symbol and row with a column for each component (indicator-component); what is missing is 0."""
    df = series.withColumn("_c", F.concat_ws("-", "indicator", "component"))
    return df.groupBy("symbol", "i").pivot("_c", components).agg(F.first("value", ignorenulls=True)).fillna(0.0, components)


def document(series: DataFrame, found: DataFrame) -> DataFrame:
    """One JSON document for each symbol and indicator: its components in order and its signals."""
    cells = series.groupBy("symbol", "indicator", "component").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("v"))
    tabular = cells.groupBy("symbol", "indicator").agg(F.map_from_entries(F.collect_list(F.struct("component", F.transform("v", lambda x: x["value"])))).alias("tabular"))
    events = found.groupBy("symbol", "indicator").agg(F.array_sort(F.collect_list(F.struct("i", "dt", "type", "value"))).alias("signals"))
    return tabular.join(events, ["symbol", "indicator"], "left").select("symbol", "indicator", F.to_json(F.struct("tabular", "signals")).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("symbol").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("symbol").option("header", True).csv(path)


def write_tables(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("symbol").parquet(path)
