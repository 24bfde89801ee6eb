"""Measures across symbols: beta and risk, relative strength, composites, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import lag, ordered, over_largest, ratio, rows, whole
from .oscillators import cluster_oscillators


def returns(bars: DataFrame) -> DataFrame:
    """bars plus ret: the percent change of the close, 0 for the first row."""
    return bars.withColumn("ret", F.coalesce(ratio(F.col("close") - lag("close"), lag("close")) * 100.0, F.lit(0.0)))


def against(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Returns of each symbol beside the market's on the same date. The market has one row a date: Spark broadcasts it while it is
    below its threshold and sorts beyond."""
    m = returns(market).select("dt", F.col("ret").alias("market_ret"), F.col("close").alias("market_close"), F.col("adj_close").alias("market_adj"))
    return returns(bars).join(m, "dt")


def beta(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Slope and r squared of the returns of each symbol over those of the market, the first (0) included."""
    return against(bars, market).groupBy("symbol").agg(F.regr_slope("ret", "market_ret").alias("beta"), F.regr_r2("ret", "market_ret").alias("r_squared"))


def beta_lists(series: DataFrame, benchmark: DataFrame, x: str = "close") -> DataFrame:
    """beta of any column of each symbol over that of a benchmark, row by row from the first on, whatever their dates."""
    change = F.coalesce(ratio(F.col(x) - lag(x), lag(x)) * 100.0, F.lit(0.0))
    own, other = (df.select("symbol", "i", change.alias(name)) for df, name in ((series, "ret"), (benchmark, "market_ret")))
    return own.join(other.drop("symbol"), "i").groupBy("symbol").agg(F.regr_slope("ret", "market_ret").alias("beta"), F.regr_r2("ret", "market_ret").alias("r_squared"))


def annual_returns(bars: DataFrame, interval: int = 250) -> DataFrame:
    """For each symbol: mean of the last year's return and the sum of four trailing quarters', and the mean deviation of both.

    A year has interval rows (200 where there are no more than interval); parts that reach beyond the first row don't count.
    """
    year = F.when(F.col("n") <= interval, F.lit(200)).otherwise(F.lit(interval))
    p = bars.withColumn("_y", year).withColumn("_k", F.col("n") - F.col("i"))  # 1 for the last row
    change = lambda a, b: ratio(F.col(a) - F.col(b), b) * 100.0
    quarters = [(1, 62), (63, 125), (126, 187), (188, 250)]
    w = whole()
    p = p.withColumns({f"_a{k}": F.max(F.when(F.col("_k") == k, F.col("adj_close"))).over(w) for k in sorted({k for q in quarters for k in q})} | {"_old": F.max(F.when(F.col("_k") == F.col("_y"), F.col("adj_close"))).over(w)})
    quarterly = sum((F.coalesce(change(f"_a{a}", f"_a{b}"), F.lit(0.0)) for a, b in quarters), F.lit(0.0))
    p = p.withColumns({"_annual": F.coalesce(change("_a1", "_old"), F.lit(0.0)), "_quarterly": quarterly})
    p = p.withColumns({"_yr": F.when((F.col("i") > 0) & (F.col("i") % F.col("_y") == 0), F.col("adj_close")), "_yb": F.col("adj_close")})
    p = p.withColumn("_yo", F.lag("adj_close", interval).over(ordered())).withColumn("_yo2", F.lag("adj_close", 200).over(ordered()))
    yearly = ratio(F.col("_yr") - F.when(F.col("_y") == 200, F.col("_yo2")).otherwise(F.col("_yo")), F.when(F.col("_y") == 200, F.col("_yo2")).otherwise(F.col("_yo"))) * 100.0
    out = p.withColumn("_ye", yearly).groupBy("symbol").agg(F.max("_annual").alias("a"), F.max("_quarterly").alias("q"), F.coalesce(F.stddev_pop("_ye"), F.lit(0.0)).alias("s"))
    return out.select("symbol", ((F.col("a") + F.col("q")) / 2.0).alias("annual_return"), (F.col("s") / 2.0).alias("deviation"))


def interval_deviation(bars: DataFrame, interval: int = 250) -> DataFrame:
    """Mean, median and deviation of the fractional returns of the last rows, the first of them 0."""
    last = bars.filter(F.col("i") >= F.col("n") - interval).withColumn("_r", F.coalesce(ratio(F.col("adj_close") - lag("adj_close"), lag("adj_close")), F.lit(0.0)))
    return last.groupBy("symbol").agg(F.avg("_r").alias("mean_return"), F.median("_r").alias("median_return"), F.stddev_pop("_r").alias("interval_deviation"))


def risk(bars: DataFrame, market: DataFrame, treasury: float | DataFrame = 0.0) -> DataFrame:
    """alpha, beta, r squared, Sharpe ratio and its ratio to the market's, and deviations; null where undefined.

    treasury is the riskless return in percent, or bars whose last close is it.
    """
    if isinstance(treasury, DataFrame):
        t = treasury.agg(F.max_by("close", "i").alias("t"))
    else:
        t = bars.sparkSession.range(1).select(F.lit(float(treasury)).alias("t"))
    m = annual_returns(market).select(F.col("annual_return").alias("mr"), F.col("deviation").alias("ms")).join(interval_deviation(market).select(F.col("interval_deviation").alias("mi")))
    one = F.broadcast(m.join(t))  # a single row
    df = annual_returns(bars).join(interval_deviation(bars), "symbol").join(beta(bars, market), "symbol").join(one)
    b = F.bround("beta", 4)
    sharpe = F.bround(ratio(F.col("annual_return") - F.col("t"), "deviation"), 4)
    market_sharpe = F.bround(ratio(F.col("mr") - F.col("t"), "ms"), 4)
    return df.select(
        "symbol", F.bround(F.col("annual_return") - F.col("t") - b * (F.col("mr") - F.col("t")), 4).alias("alpha"), b.alias("beta"), F.bround("r_squared", 4).alias("r_squared"), sharpe.alias("sharpe"),
        F.bround(ratio(sharpe, market_sharpe), 4).alias("market_sharpe"), F.bround("deviation", 4).alias("standard_deviation"), F.bround(ratio("interval_deviation", "mi"), 4).alias("standard_dev_ratio"),
    )


def normalized_ratio(bars: DataFrame, market: DataFrame) -> DataFrame:
    """bars plus ratio: the price over the market's, relative to the first common date, less 1."""
    df = against(bars, market)
    q = ratio("adj_close", "market_adj")
    df = df.withColumn("_q", q).withColumn("_q0", F.bround(F.first("_q").over(rows(Window.unboundedPreceding, 0)), 6))
    return df.withColumn("ratio", F.bround(ratio("_q", "_q0") - 1.0, 6)).select(*bars.columns, "ratio")


def period_strength(bars: DataFrame, market: DataFrame, periods: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Average, deviation, extremes and last value of the ratio to the market, from each look-back on."""
    df = against(bars, market).withColumn("_q", ratio("adj_close", "market_adj")).select("symbol", "i", "n", "_q", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    df = df.filter(F.col("i") >= F.col("n") - F.col("period")).withColumn("_q0", F.bround(F.first("_q").over(Window.partitionBy("symbol", "period").orderBy("i")), 6))
    df = df.withColumn("_r", F.bround(ratio("_q", "_q0") - 1.0, 6))
    return df.groupBy("symbol", "period").agg(F.avg("_r").alias("average"), F.stddev_pop("_r").alias("deviation"), F.min("_r").alias("lowest"), F.max("_r").alias("highest"), F.max_by("_r", "i").alias("current"))


def relative_strength(bars: DataFrame, benchmarks: dict[str, DataFrame]) -> DataFrame:
    """normalized_ratio against several benchmarks (market, sector, peers), in long form."""
    out = None
    for name, m in benchmarks.items():
        one = normalized_ratio(bars, m).select("symbol", "i", "dt", F.lit(name).alias("benchmark"), "ratio")
        out = one if out is None else out.unionByName(one)
    return out


def sector_funds(assigned: DataFrame, sectors: DataFrame) -> DataFrame:
    """symbol, sector, etf and peers of each symbol whose sector is known, by its name without regard to case.

    assigned: symbol, sector; sectors: sector, etf, peers (see sources.config.sector_table), a dimension that is joined by key.
    """
    known = sectors.select(F.lower("sector").alias("_s"), "etf", "peers")
    out = assigned.withColumn("_s", F.lower("sector")).join(known, "_s").drop("_s")
    return out.withColumn("peers", F.array_except("peers", F.array("symbol")))


def sector_strength(bars: DataFrame, members: DataFrame) -> DataFrame:
    """The ratio of each symbol to its sector's fund and to each of its peers, relative to the first common date, less 1.

    members: what sector_funds gives. Symbols meet their funds by (symbol of the fund, date).
    """
    against_all = members.select("symbol", F.explode(F.concat(F.array(F.struct(F.col("etf").alias("fund"), F.lit("sector").alias("kind"))), F.transform("peers", lambda p: F.struct(p.alias("fund"), F.lit("peer").alias("kind"))))).alias("x")).select("symbol", "x.*").filter("symbol <> fund")
    funds = bars.select(F.col("symbol").alias("fund"), "dt", F.col("adj_close").alias("_m"))
    df = bars.select("symbol", "i", "dt", "adj_close").join(against_all, "symbol").join(funds, ["fund", "dt"]).withColumn("_q", ratio("adj_close", "_m"))
    first = F.bround(F.first("_q").over(Window.partitionBy("symbol", "kind", "fund").orderBy("i")), 6)
    return df.select("symbol", "kind", "fund", "i", "dt", F.bround(ratio("_q", first) - 1.0, 6).alias("ratio"))


def future_returns(bars: DataFrame, ahead: tuple[int, ...] = (5, 15, 45, 90)) -> DataFrame:
    """bars plus future_n: the change in percent n rows on, three digits, 0 at the tail."""
    return bars.withColumns({f"future_{k}": F.coalesce(F.bround(ratio(lag("close", -k) - F.col("close"), "close") * 100.0, 3), F.lit(0.0)) for k in ahead})


def head_statistics(bars: DataFrame) -> DataFrame:
    """Last price, its change, the change in percent, and the highest close."""
    df = bars.withColumn("_was", lag("close"))
    out = df.groupBy("symbol").agg(F.max_by("close", "i").alias("c"), F.max_by("_was", "i").alias("b"), F.max("close").alias("m"))
    return out.select("symbol", F.bround("c", 2).alias("current_price"), F.bround(F.col("c") - F.col("b"), 2).alias("change"), F.bround(ratio(F.col("c") - F.col("b"), "b") * 100.0, 3).alias("percent_change"), F.bround("m", 2).alias("max_close"))


# --- composites: rows of one date, summed over symbols. Windows over dates alone run on the calendar, not on the symbols ------------


def _calendar(df: DataFrame, name: str) -> DataFrame:
    """One series by date as a table of one symbol, numbered."""
    out = df.withColumn("symbol", F.lit(name)).withColumn("i", (F.row_number().over(Window.partitionBy("symbol").orderBy("dt")) - 1).cast("long"))
    return out.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))


def _centred3(x: str) -> Column:
    inner = (F.col("i") >= 1) & (F.col("i") < F.col("n") - 1)
    return F.when(inner, F.avg(x).over(rows(-1, 0))).otherwise(F.col(x))


def market_composite(bars: DataFrame) -> DataFrame:
    """Clusters of the market set summed over all symbols by date, averaged over a centred window of 3 and scaled."""
    sums = cluster_oscillators(bars, "market").groupBy("dt").agg(F.sum("clustered").alias("_x"))
    df = _calendar(sums, "composite").withColumn("_y", _centred3("_x"))
    return df.withColumn("composite", over_largest("_y")).select("i", "dt", "composite")


def weighted_index(bars: DataFrame, weights: DataFrame, start: float = 25.0) -> DataFrame:
    """By index name and date: the weighted returns of its symbols compounded from start. weights: name, symbol, weight.

    The table of weights is joined by symbol; Spark broadcasts it while it is below its threshold.
    """
    r = returns(bars).join(weights, "symbol").groupBy("name", "dt").agg(F.sum(F.col("ret") * F.col("weight")).alias("r"))
    w = Window.partitionBy("name").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("name", "dt", (F.lit(start) * F.exp(F.sum(F.log1p(F.greatest(F.col("r"), F.lit(-99.0)) / 100.0)).over(w))).alias("value"))


def weighted_clusters(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """By index name and date: clusters of all oscillators, weighted and scaled."""
    c = cluster_oscillators(bars, "all").join(weights, "symbol").groupBy("name", "dt").agg(F.sum(F.col("clustered") * F.col("weight")).alias("_x"))
    top = F.max(F.abs("_x")).over(Window.partitionBy("name"))
    return c.withColumn("_top", top).select("name", "dt", F.when(F.col("_top") > 0, F.col("_x") / F.col("_top")).otherwise(F.col("_x")).alias("cluster"))


def composite_correlation(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Beta and r squared of each symbol over the second half and over the whole period."""
    df = against(bars, market)
    later = F.col("i") >= F.floor(F.col("n") / 2)
    r, m = F.when(later, F.col("ret")), F.when(later, F.col("market_ret"))
    out = df.groupBy("symbol").agg(F.regr_slope("ret", "market_ret").alias("b"), F.regr_r2("ret", "market_ret").alias("r"), F.regr_slope(r, m).alias("bh"), F.regr_r2(r, m).alias("rh"))
    return out.select("symbol", F.bround("b", 5).alias("beta"), F.bround("r", 5).alias("r_squared"), F.bround("bh", 5).alias("beta_half"), F.bround("rh", 5).alias("r_squared_half"))


def rolling_r_squared(bars: DataFrame, market: DataFrame, window: int) -> DataFrame:
    """r squared over the window - 1 rows before the row and one pair (0, 0), since a window's first return is 0; 0 before."""
    w = rows(1 - window, -1)
    df = against(bars, market)
    x, y, n = F.col("market_ret"), F.col("ret"), float(window)
    df = df.withColumns({"_x": F.sum(x).over(w), "_y": F.sum(y).over(w), "_xx": F.sum(x * x).over(w), "_yy": F.sum(y * y).over(w), "_xy": F.sum(x * y).over(w)})
    cov = F.col("_xy") * n - F.col("_x") * F.col("_y")
    den = (F.col("_xx") * n - F.col("_x") * F.col("_x")) * (F.col("_yy") * n - F.col("_y") * F.col("_y"))
    value = F.when(F.col("i") < window, F.lit(0.0)).otherwise(F.coalesce(F.when(den > 0, cov * cov / den), F.lit(0.0)))
    return df.select("symbol", "i", "dt", value.alias("r_squared"))


def correlation_index(bars: DataFrame, market: DataFrame, windows: tuple[int, ...] = (100, 50, 25), weights: tuple[float, ...] = (1.5, 1.25, 1.0)) -> DataFrame:
    """By date: rolling r squared summed over symbols for each window and scaled, their weighted sum, its average over 20 rows and
    the difference."""
    df = None
    for w in windows:
        one = rolling_r_squared(bars, market, w).groupBy("dt").agg(F.sum("r_squared").alias(f"_{w}"))
        df = one if df is None else df.join(one, "dt")
    df = _calendar(df, "correlation").withColumns({f"corr_{w}": over_largest(f"_{w}") for w in windows})
    df = df.withColumn("overall", sum((F.col(f"corr_{w}") * k for w, k in zip(windows, weights, strict=True)), F.lit(0.0)))
    df = df.withColumn("line", F.when(F.col("n") > 23, F.when(F.col("i") < 19, F.col("overall")).otherwise(F.avg("overall").over(rows(-19, 0)))))
    return df.select("i", "dt", *[f"corr_{w}" for w in windows], "overall", "line", (F.col("overall") - F.col("line")).alias("difference"))
