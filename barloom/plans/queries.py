"""Named queries over the driver's tables: each takes (spark, sf_dir). Bars are order prices by week; see sources.bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import neat, over_largest, slope
from ..operators import candles, cross, features, fundamentals, lines, oscillators, portfolio, report, trend, volatility
from ..sources import bars as src
from ..sources import files
from ..streaming.bars import batch_bars
from .candle_rows import line_candles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def series(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", "i", *[neat(c).alias(c) for c in columns])


def events(df: DataFrame) -> DataFrame:
    return df.select("symbol", "i", "dt", "type", "value")


def on_bars(name: str, f: Callable[[DataFrame], DataFrame], *columns: str, find: Callable = src.weekly_bars) -> None:
    QUERIES[name] = lambda spark, sf: series(f(find(spark, sf)), *columns) if columns else f(find(spark, sf))


def on_signals(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: events(f(src.weekly_bars(spark, sf)))


def on_market(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: f(src.weekly_bars(spark, sf), src.market_bars(spark, sf))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[neat(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def steady(df: DataFrame) -> DataFrame:
    """One digit, and the noise of sums rounded off before: fits of prices lie between two of these often."""
    return rounded(rounded(df, 6), 1)


# sources
on_bars("bars_weekly", lambda b: b, "open", "high", "low", "close", "volume")
on_bars("bars_nation", lambda b: b, "open", "high", "low", "close", "volume", find=src.nation_bars)
on_bars("bars_market", lambda b: b, "open", "high", "low", "close", "volume", find=src.market_bars)
on_bars("resample_quarter", lambda b: src.resample(b, "quarter"), "open", "high", "low", "close", "volume")
on_bars("last_period", lambda b: src.last_period(b, 24), "close")
on_bars("single_fund", lambda b: src.one_fund(b, "1-URGENT"), "close")
on_bars("symbol_list", lambda b: src.symbols_of(b))


def _gappy(b: DataFrame) -> DataFrame:
    gap = (F.col("i") % 7 == 3) | ((F.col("i") % 50).between(20, 22)) | (F.col("i") == 0)
    return b.withColumns({c: F.when(gap, F.lit(None).cast("double")).otherwise(F.col(c)) for c in src.PRICES})


on_bars("nan_repair", lambda b: src.repair(_gappy(b)).select("symbol", "i", *[neat(c, 0).alias(c) for c in ("open", "high", "low", "close")]))
on_bars("repair_log", lambda b: src.repair_log(_gappy(b)).select("symbol", "status", "n_rows"))
on_bars("validity_gate", lambda b: src.invalid(b.withColumn("close", F.when(F.col("symbol") != "5-LOW", F.col("close")))).select("symbol", "n_missing", "n_rows"))
QUERIES["calendar_align"] = lambda spark, sf: series(src.aligned(src.nation_bars(spark, sf).filter("i % 5 <> 2"), src.nation_bars(spark, sf)), "open", "close")
QUERIES["calendar_inserted"] = lambda spark, sf: src.inserted((b := src.nation_bars(spark, sf)).filter("i % 5 <> 2"), src.calendar_of(b))
on_bars("wide_to_long", lambda b: src.from_wide(b.groupBy("dt").pivot("symbol", ["1-URGENT", "5-LOW"]).agg(*[F.first(c).alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")]), ["1-URGENT", "5-LOW"]).select("symbol", "dt", neat("close").alias("close")))
on_bars("stats_high_level", cross.head_statistics)

# averages and trends
on_bars("typical_price", lambda b: b.withColumn("typical", trend.typical_price()), "typical")
on_bars("mid_price", lambda b: b.withColumn("mid", trend.mid_price()), "mid")
on_bars("percent_change", lambda b: b.withColumn("change", trend.percent_change()), "change")
on_bars("sma", trend.simple_average, "sma")
on_bars("ema", trend.exponential_average, "ema")
on_bars("wma", trend.weighted_average, "wma")
on_bars("windowed_ma_simple", trend.windowed_average, "windowed")
on_bars("windowed_ma_exp", lambda b: trend.windowed_average(b, 10, 2.0), "windowed")
on_bars("sma_triple", lambda b: rounded(trend.triple_average(b), 5).select("symbol", "i", "short", "medium", "long", "short_pct", "medium_pct", "long_pct"))
on_bars("ema_triple", lambda b: trend.triple_average(b, (9, 20, 50), "ema"), "short", "medium", "long", "short_pct", "medium_pct", "long_pct")
on_signals("ma_crossovers", lambda b: trend.crossovers(trend.triple_average(b)))
on_signals("ema_crossovers", lambda b: trend.crossovers(trend.triple_average(b, (9, 20, 50), "ema"), (9, 20, 50)))
on_bars("offset_trim", lambda b: trend.offset_trim(trend.simple_average(b), 30), "sma")
on_bars("swing_states", lambda b: trend.swing_states(trend.triple_average(b, (4, 9, 18)), 18).select("symbol", "i", "state"))
on_bars("swing_trade", trend.swing_trade, "swing", "metric")
on_signals("swing_signals", trend.swing_signals)
on_bars("hull", trend.hull_average, "short", "medium", "long")
on_bars("hull_swing", lambda b: trend.swing_trade(b, (9, 16, 36), "hull"), "swing", "metric")
on_bars("psar", trend.parabolic_sar, "sar_fast", "sar_slow", "sar_fast_pct", "sar_slow_pct")
on_signals("psar_signals", trend.sar_signals)
on_bars("auto_trend", trend.auto_trend, "trend")
on_bars("trend_report", trend.trend_report)
on_bars("normalize", lambda b: b.withColumn("x", slope("close", 14)).withColumn("scaled", over_largest("x")), "scaled")

# oscillators
on_bars("stochastic", oscillators.stochastic, "fast_k", "smooth_k", "slow_d")
on_signals("stochastic_signals", oscillators.stochastic_signals)
on_bars("stochastic_metric", oscillators.stochastic_metric, "metric")
on_bars("rsi", lambda b: oscillators.rsi(b).select("symbol", "i", neat("rsi", 2).alias("rsi")))
on_bars("rsi_thresholds", oscillators.rsi_thresholds, "oversold", "overbought")
on_signals("rsi_signals", oscillators.rsi_signals)
on_bars("rsi_metric", oscillators.rsi_metric, "metric")
on_bars("ultimate", oscillators.ultimate, "ultimate")
on_signals("ultimate_signals", oscillators.ultimate_signals)
on_bars("ultimate_metric", oscillators.ultimate_metric, "metric")
for _f in ("all", "market", "full_stochastic", "ultimate", "rsi"):
    on_bars(f"cluster_{_f}", lambda b, f=_f: oscillators.cluster_oscillators(b, f), "clustered")
on_bars("cluster_dates", lambda b: rounded(oscillators.cluster_dates(b)))
on_bars("cluster_metric", oscillators.cluster_metric, "metric")
on_signals("cluster_signals", oscillators.cluster_signals)
on_bars("macd", oscillators.macd, "macd", "signal_line", "bar")
on_signals("macd_signals", oscillators.macd_signals)
on_bars("macd_metric", oscillators.macd_metric, "metric")
on_bars("macd_stats", lambda b: rounded(oscillators.macd_statistics(b)))
on_bars("macd_runs", lambda b: rounded(oscillators.macd_runs(b)).select("symbol", "i", "run_start", "run_end", "run_rows", "group_value", "factor"))
on_bars("awesome", oscillators.awesome, "awesome", "medium", "long")
on_bars("awesome_trigger", lambda b: oscillators.awesome(b).select("symbol", "i", oscillators.awesome_trigger().alias("trigger")))
on_signals("awesome_signals", oscillators.awesome_signals)
on_signals("awesome_zero", lambda b: oscillators.zero_crossings(oscillators.awesome(b), "awesome"))
on_bars("awesome_metric", oscillators.awesome_metric, "metric")
on_bars("momentum", oscillators.momentum, "momentum", "momentum_line", "compared")
on_signals("momentum_signals", lambda b: oscillators.momentum_signals(b, 0.1))
on_bars("momentum_metric", oscillators.momentum_metric, "metric", "change")
on_bars("roc", oscillators.rate_of_change, "roc_10", "roc_20", "roc_40")
on_signals("roc_signals", oscillators.roc_signals)
on_signals("roc_zero", lambda b: oscillators.zero_crossings(oscillators.rate_of_change(b), "roc_20", "zero crossover 20d"))
on_bars("roc_metric", oscillators.roc_metric, "metric")
on_bars("kst", oscillators.know_sure_thing, "kst", "kst_line")
on_signals("kst_signals", oscillators.kst_signals)
on_bars("cci", oscillators.commodity_channel, "cci_20", "cci_40", "cci_80")
on_signals("cci_signals", oscillators.cci_signals)
on_bars("cci_metric", oscillators.cci_metric, "metric")

# volatility, volume, power
on_bars("atr", volatility.average_true_range, "true_range", "atr")
on_signals("atr_signals", volatility.atr_signals)
on_bars("adx", volatility.directional_index, "di_plus", "di_minus", "adx")
on_signals("adx_signals", volatility.adx_signals)
on_bars("obv", volatility.on_balance_volume, "obv")
on_bars("obv_spikes", volatility.obv_spikes, "spike")
on_signals("obv_signals", volatility.obv_signals)
on_bars("demand_index", volatility.demand_index, "demand_index")
on_signals("demand_signals", volatility.demand_signals)
on_bars("demand_metric", volatility.demand_metric, "metric")
on_bars("bollinger", volatility.bollinger, "middle", "upper", "lower")
on_bars("bollinger_10", lambda b: volatility.bollinger(b, 10, 1.5), "middle", "upper", "lower")
on_bars("volatility_blend", volatility.volatility_blend, "volatility")
on_signals("bollinger_signals", volatility.bollinger_signals)
on_bars("bollinger_metric", volatility.bollinger_metric, "metric")
on_bars("bear_bull", volatility.bear_bull_power, "bulls", "bears")
on_signals("bear_bull_signals", volatility.bear_bull_signals)
on_bars("bear_bull_metric", volatility.bear_bull_metric, "metric")
on_bars("total_power", volatility.total_power, "bulls", "bears", "total")
on_signals("total_power_signals", volatility.total_power_signals)
on_bars("total_power_metric", volatility.total_power_metric, "metric")
on_bars("zone_islands", lambda b: volatility.zone_islands(oscillators.rate_of_change(b), "roc_10").select("symbol", "sign", "first_i", "last_i", "n_rows", neat("extreme").alias("extreme")))

# chart features
on_bars("price_gaps", lambda b: features.price_gaps(b).select("symbol", "i", "direction", neat("difference").alias("difference")))
on_bars("gap_trends", features.gap_trends, "trend_7", "trend_14", "trend_28")
on_bars("zigzag", features.zigzag_extrema)
on_bars("filtered_extrema", lambda b: features.filtered_extrema(b, "close").filter("kind is not null").select("symbol", "i", "kind"))
on_bars("extrema", lambda b: features.extrema(b, 8).select("symbol", "i", neat("value").alias("value"), "kind"))
on_bars("head_shoulders", lambda b: rounded(features.head_and_shoulders(b, 4)).drop("filter_size"))
on_bars("head_shoulders_all", lambda b: rounded(features.all_head_and_shoulders(b)))
on_bars("support_points", features.turning_points)
on_bars("support_clusters", lambda b: features.price_clusters(features.turning_points(b)).withColumn("price", neat("price", 0)))
on_bars("support_levels", features.levels_of)
on_bars("support_resistance", lambda b: rounded(features.support_resistance(b), 2))
on_bars("nearest_levels", lambda b: features.nearest_levels(features.levels_of(b), b))
on_bars("trend_lines", lambda b: steady(lines.trend_lines(b)))
on_bars("trend_forecast", lambda b: steady(lines.line_forecast(lines.trend_lines(b), b)))
on_bars("trend_touches", lambda b: rounded(lines.line_touches(lines.trend_lines(b), b)))
on_bars("trend_periods", lambda b: lines.line_periods(lines.trend_lines(b), b))
on_bars("obv_trend_lines", lambda b: steady(_obv_lines(b)))
on_bars("channel_lines", lambda b: steady(lines.channel_lines(b)).drop("id"))
on_bars("line_groups", lambda b: steady(lines.line_groups(lines.channel_lines(b), b)).drop("id"))
on_bars("nearest_lines", lambda b: steady(lines.nearest_lines(lines.line_groups(lines.channel_lines(b), b), b)).drop("above_id", "below_id"))


def _obv_lines(b: DataFrame) -> DataFrame:
    obv = volatility.on_balance_volume(b).withColumn("close", F.col("obv"))
    return lines.trend_lines(obv, (0, 2, 4, 7), (3, 15, 31, 0.25))


# candles
on_bars("candle_class", lambda b: candles.classify(b).select("symbol", "i", "trend", "body", "vol_body", "white", "doji", neat("shadow_ratio").alias("shadow_ratio")))
on_bars("candle_patterns", candles.all_patterns)
on_bars("candle_patterns_line", candles.all_patterns, find=line_candles)
on_signals("candle_signals", candles.candle_signals)
on_bars("candle_reversals", candles.reversal_patterns, find=line_candles)
on_bars("candle_reversals_unconfirmed", lambda b: candles.reversal_patterns(b, confirmed=False), find=line_candles)
for _p in candles.PATTERNS:
    on_bars(f"candle_{_p.replace(' ', '_')}", lambda b, p=_p: candles.pattern(b, p), find=line_candles)

# across symbols
on_market("beta", lambda b, m: rounded(cross.beta(b, m)))
on_market("beta_lists", lambda b, m: rounded(cross.beta_lists(trend.simple_average(b), trend.simple_average(m), "sma")))
on_market("risk_ratios", lambda b, m: rounded(cross.risk(b, m, 2.5)))
on_bars("annual_returns", lambda b: rounded(cross.annual_returns(b)))
on_bars("interval_deviation", lambda b: rounded(cross.interval_deviation(b)))
on_market("normalized_ratio", lambda b, m: series(cross.normalized_ratio(b, m), "ratio"))
on_market("period_strength", lambda b, m: rounded(cross.period_strength(b, m)))
QUERIES["relative_strength"] = lambda spark, sf: rounded(cross.relative_strength(b := src.weekly_bars(spark, sf), {"market": src.market_bars(spark, sf), "peer": src.one_fund(b, "5-LOW")}), 6)
on_bars("future_returns", cross.future_returns, "future_5", "future_15", "future_45", "future_90")
QUERIES["mci"] = lambda spark, sf: rounded(cross.market_composite(src.nation_bars(spark, sf)))
on_market("mci_correlation", cross.composite_correlation)
on_market("rolling_correlation", lambda b, m: rounded(cross.rolling_r_squared(b, m, 50)))
on_market("correlation_index", lambda b, m: rounded(cross.correlation_index(b, m)))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of each region in equal parts."""
    n, r = src.read_table(spark, sf, "nation"), src.read_table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_nationkey").cast("string").alias("symbol"), F.lit(0.2).alias("weight"))


def _logs(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "dt", neat(F.log("value"), 6).alias("log_value"))


QUERIES["bci"] = lambda spark, sf: _logs(cross.weighted_index(src.nation_bars(spark, sf), _weights(spark, sf)), "name")
QUERIES["tci"] = lambda spark, sf: rounded(cross.weighted_clusters(src.nation_bars(spark, sf), _weights(spark, sf)))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with the first nation of their region as its fund and the next three as peers."""
    n, r = src.read_table(spark, sf, "nation"), src.read_table(spark, sf, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    keys = F.array_sort(F.collect_list("n_nationkey"))
    sectors = both.groupBy(F.col("r_name").alias("sector")).agg(keys.alias("k")).select("sector", F.get("k", F.lit(0)).cast("string").alias("etf"), F.transform(F.slice("k", 2, 3), lambda x: x.cast("string")).alias("peers"))
    return cross.sector_funds(both.select(F.col("n_nationkey").cast("string").alias("symbol"), F.lower("r_name").alias("sector")), sectors)


QUERIES["sector_funds"] = lambda spark, sf: _members(spark, sf).select("symbol", "sector", "etf", F.array_join("peers", ",").alias("peers"))
QUERIES["sector_strength"] = lambda spark, sf: rounded(cross.sector_strength(src.nation_bars(spark, sf), _members(spark, sf)), 6)

# reports


def _found(b: DataFrame) -> DataFrame:
    return report.all_signals({"average": trend.crossovers(trend.triple_average(b)), "awesome": oscillators.zero_crossings(oscillators.awesome(b), "awesome"), "atr": volatility.atr_signals(b)})


def _series(b: DataFrame) -> DataFrame:
    return report.long_series(trend.triple_average(b), "average", "short", "medium").unionByName(report.long_series(volatility.average_true_range(b), "atr", "atr"))


on_bars("last_signals", lambda b: report.last_signals(report.indicator_signals(b), b))
on_bars("merged_signals", lambda b: report.merged_signals(report.all_signals({"average": trend.crossovers(trend.triple_average(b)), "stochastic": oscillators.stochastic_signals(b), "rsi": oscillators.rsi_signals(b), "macd": oscillators.macd_signals(b)})))
on_bars("overall_metric", lambda b: rounded(report.overall_metric({"bands": ("trend", volatility.bollinger_metric(b), "metric"), "rsi": ("oscillator", oscillators.rsi_metric(b), "metric")})))
on_bars("synopsis", lambda b: rounded(report.synopsis(_series(b), {"average": "trend", "atr": "oscillator"})))
on_bars("export_pivot", lambda b: rounded(report.export_pivot(_series(b), ["average-short", "average-medium", "atr-atr"])))
on_bars("export_filter", lambda b: rounded(report.export_filter(_series(b), "5-low atr").select("symbol", "i", "indicator", "component", "value")))
on_bars("analysis_document", lambda b: report.document(_series(b), _found(b)))

# portfolios: lineitem as trades of a priority on the Monday of the order's week


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    o, x = src.read_table(spark, sf, "orders"), src.read_table(spark, sf, "lineitem")
    df = x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select(F.col("o_orderpriority").alias("stock"), F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("action"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.date_trunc("week", "o_orderdate").cast("date").alias("dt"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("shares"))


def _dividends(spark: SparkSession, sf: str) -> DataFrame:
    b = src.weekly_bars(spark, sf).filter("i % 13 = 6")
    return b.select("symbol", "dt", F.bround(F.col("close") * 0.01, 2).alias("dividend"))


def _ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The trades, with a fund for every seventh supplier."""
    o, x = src.read_table(spark, sf, "orders"), src.read_table(spark, sf, "lineitem")
    df = x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select(
        F.concat(F.lit("FUND"), (F.col("l_suppkey") % 7).cast("string")).alias("ticker"), F.concat(F.lit("Fund of part, "), (F.col("l_suppkey") % 7).cast("string")).alias("title"), F.lit(1e6).alias("start_capital"), F.concat(F.lit("P"), F.col("l_partkey") % 50).alias("stock"),
        F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("action"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), F.col("o_orderdate").cast("date").alias("dt"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("shares"),
    )


def ledger_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write ledgers, read them back, and sum up what each stock did in each fund."""
    path = files.shared_path(spark, "ledgers")
    files.write_ledgers(_ledger_rows(spark, sf), path, by_year=True)
    back = spark.read.format("ledger").load(path)
    return rounded(back.groupBy("ticker", "title", "start_capital", "stock", "action").agg(F.count("*").alias("n_trades"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.sum(F.col("shares").cast("decimal(18,2)")).cast("double").alias("shares"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount")), 2)


def config_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write a run configuration for each region, of its nations, and read what is to run."""
    n, r = src.read_table(spark, sf, "nation"), src.read_table(spark, sf, "region")
    symbols = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey").agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("symbols"))
    indexes = F.struct((F.col("r_regionkey") % 2 == 0).alias("mci"), (F.col("r_regionkey") > 2).alias("bci"))
    own = F.struct(F.array(F.lit("2y"), F.lit("5y")).alias("Period"), F.array(F.lit("1w")).alias("Interval"), indexes.alias("Indexes"))
    text = F.to_json(F.struct(own.alias("Properties"), F.struct((F.col("r_regionkey") > 0).alias("run"), F.lower("r_name").alias("fields")).alias("Exports"), F.col("symbols").alias("Ticker Symbols")))
    path = files.shared_path(spark, "configs")
    symbols.select(text.alias("value")).write.text(path)
    files.register(spark)
    found = spark.read.format("run_config").load(path)
    return found.select("symbol", "period", "months", "interval", F.array_join("indexes", ",").alias("indexes"), "export")


def exported_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = files.shared_path(spark, "export")
    report.write_csv(report.export_pivot(_series(src.weekly_bars(spark, sf)), ["average-short", "average-medium", "atr-atr"]), path)
    back = spark.read.option("header", True).csv(path)
    return rounded(back.select("symbol", F.col("i").cast("long").alias("i"), *[F.col(f"`{c}`").cast("double").alias(c) for c in ("average-short", "average-medium", "atr-atr")]))


def exported_json(spark: SparkSession, sf: str) -> DataFrame:
    path = files.shared_path(spark, "export")
    report.write_json(report.document(_series(src.weekly_bars(spark, sf)), _found(src.weekly_bars(spark, sf))), path)
    shape = "struct<tabular: map<string, array<double>>, signals: array<struct<i: long, type: string>>>"
    back = spark.read.schema("symbol string, indicator string, document string").json(path).select("symbol", "indicator", F.from_json("document", shape).alias("d"))
    cells = back.select("symbol", "indicator", F.size("d.signals").alias("n_signals"), F.explode("d.tabular").alias("component", "v"))
    return rounded(cells.select("symbol", "indicator", "component", F.greatest("n_signals", F.lit(0)).alias("n_signals"), F.size("v").alias("n_values"), F.element_at("v", -1).alias("last")))


QUERIES["ledger_files"] = ledger_files
QUERIES["config_files"] = config_files
QUERIES["export_csv"] = exported_csv
QUERIES["export_json"] = exported_json
QUERIES["synthetic_fund"] = lambda spark, sf: _logs(portfolio.synthetic_fund(src.nation_bars(spark, sf), _weights(spark, sf).withColumnRenamed("name", "fund").withColumn("weight", F.col("weight") * 0.9).unionByName(src.read_table(spark, sf, "region").select(F.col("r_name").alias("fund"), F.lit(portfolio.CASH).alias("symbol"), F.lit(0.1).alias("weight")))), "fund")
QUERIES["ledger_sim"] = lambda spark, sf: rounded(portfolio.ledger_simulation(_trades(spark, sf), src.weekly_bars(spark, sf)), 2)
QUERIES["holdings"] = lambda spark, sf: rounded(portfolio.holdings(_trades(spark, sf), src.weekly_bars(spark, sf)), 2)
QUERIES["dividends_quarterly"] = lambda spark, sf: rounded(portfolio.dividends_quarterly(_dividends(spark, sf), (b := src.weekly_bars(spark, sf)), b.groupBy("symbol").agg(F.lit(100.0).alias("shares"))))
QUERIES["buy_hold"] = lambda spark, sf: portfolio.buy_and_hold(src.weekly_bars(spark, sf), _dividends(spark, sf), 10_000_000.0)
on_bars("cluster_strategy", lambda b: portfolio.cluster_strategy(b, 100_000_000.0))


def _savers(spark: SparkSession, sf: str) -> DataFrame:
    """A scenario for each customer."""
    c = src.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("scenario"), (F.col("c_custkey") % 10).alias("k"))
    return c.select("scenario", (F.col("k") / 100.0).alias("rate"), (F.col("k") * 1000.0 + 5000.0).alias("contribution"), (0.05 + F.col("k") / 200.0).alias("growth_high"), F.lit(0.04).alias("growth_low"), F.lit(40_000.0).alias("withdrawal"), F.lit(43).alias("years_worked"), (F.col("k") / 10.0).alias("roth_share"))


QUERIES["retirement_sim"] = lambda spark, sf: rounded(portfolio.retirement(_savers(spark, sf).select("scenario", "contribution", "growth_high", "growth_low", "withdrawal", "years_worked", "roth_share")), 2)
QUERIES["tax_brackets"] = lambda spark, sf: rounded(portfolio.income_tax(src.read_table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("income")))).withColumn("effective_rate", neat("effective_rate", 1))
QUERIES["contribution_race"] = lambda spark, sf: rounded(portfolio.contribution_race(_savers(spark, sf), 60, 24), 2)
QUERIES["price_race"] = lambda spark, sf: rounded(portfolio.race_over(src.nation_bars(spark, sf)), 1)

# fundamentals: suppliers as companies, with items made from their parts


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    s = src.read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_acctbal").alias("b"))
    items = {"Total Assets": F.abs("b") * 3 + 100, "Current Assets": F.abs("b") + 50, "Current Liabilities": F.abs("b") * 0.5 + 40, "Retained Earnings": F.col("b"), "EBIT": F.col("b") * 0.2, "Total Revenue": F.abs("b") * 2}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in items.items()])).alias("x")
    return s.select("symbol", F.lit("balance").alias("statement"), F.to_date(F.lit("2000-12-31")).alias("dt"), cells).select("symbol", "statement", "dt", "x.item", "x.value")


QUERIES["altman_z"] = lambda spark, sf: fundamentals.altman_z(_statements(spark, sf), src.read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.abs("s_acctbal") * 4).alias("market_cap")))
QUERIES["statement_pivot"] = lambda spark, sf: rounded(fundamentals.statement(_statements(spark, sf), "balance").select("symbol", F.col("EBIT").alias("ebit"), F.col("Total Assets").alias("total_assets")))
QUERIES["eps"] = lambda spark, sf: rounded(fundamentals.earnings_per_share(
    src.read_table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol"), F.date_format("o_orderdate", "yyyy").alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("earnings")),
    src.read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), (F.col("c_custkey") % 97 + 3).cast("double").alias("shares")),
    digits=None,  # rounding twice would raise what lies just below a half
), 0)
QUERIES["recommendation_curve"] = lambda spark, sf: fundamentals.recommendation_curve(
    src.read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("dt"), (F.col("o_custkey") % 11).cast("string").alias("firm"), F.element_at(F.array(*[F.lit(g) for g in ("Strong Buy", "Buy", "Hold", "Sell", "Odd")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("grade"))
)

# streaming: the same bars from events, as a batch
QUERIES["bars_6h"] = lambda spark, sf: batch_bars(src.read_table(spark, sf, "events")).select("symbol", "dt", neat("open").alias("open"), neat("high").alias("high"), neat("low").alias("low"), neat("close").alias("close"), "volume")
