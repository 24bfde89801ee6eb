"""Bars: open, high, low, close and volume for each symbol and calendar period, and their repair, alignment and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "adj_close")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(bars: DataFrame) -> DataFrame:
    """bars plus i, the place of each row in its symbol, and n, the rows of the symbol: the only order that operators use."""
    w = Window.partitionBy("symbol")
    return bars.withColumn("i", (F.row_number().over(w.orderBy("dt")) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def placed(df: DataFrame, by: str, part: str, *order: str) -> DataFrame:
    """df plus t, the place of each row among those with its value of by, and n, how many these are; neither by nor part has nulls.

    part ascends with the order, and no value of it has many rows: each is sorted on its own and only counts are added up, so that no
    window holds all rows of a value of by.
    """
    w = Window.partitionBy(by)
    counts = df.groupBy(by, part).agg(F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(by, part, before.alias("_before"), F.sum("_count").over(w).alias("n"))
    own = df.withColumn("t", F.row_number().over(Window.partitionBy(by, part).orderBy(*order)) - 1)
    return own.join(starts, [by, part]).withColumn("t", F.col("_before") + F.col("t")).drop("_before")


def bars_from_ticks(ticks: DataFrame, symbol: Column, at: Column, price: Column, order: Column, interval: str = "week", size: Column | None = None) -> DataFrame:
    """One bar for each symbol and interval. Ticks are combined before the shuffle, so a hot symbol costs no more than any other."""
    t = ticks.select(symbol.cast("string").alias("symbol"), F.date_trunc(interval, at).cast("date").alias("dt"), price.cast("double").alias("p"), order.alias("o"), (F.lit(1.0) if size is None else size).alias("v"))
    return numbered(
        t.groupBy("symbol", "dt").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume")).withColumn("adj_close", F.col("close"))
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices by priority and week."""
    o = read_table(spark, sf_dir, "orders")
    return bars_from_ticks(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices by week: the benchmark."""
    o = read_table(spark, sf_dir, "orders")
    return bars_from_ticks(o, F.lit("^MKT"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices by the customer's nation and month."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return bars_from_ticks(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("c_nationkey"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), "month")


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of a longer interval: week, month, quarter or year."""
    keyed = bars.withColumn("to", F.date_trunc(interval, "dt").cast("date"))
    out = keyed.groupBy("symbol", "to").agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.max_by("adj_close", "dt").alias("adj_close"), F.sum("volume").alias("volume")
    )
    return numbered(out.withColumnRenamed("to", "dt"))


def last_period(bars: DataFrame, months: int) -> DataFrame:
    """The rows of each symbol within so many months of its last one."""
    last = F.max("dt").over(Window.partitionBy("symbol"))
    return numbered(bars.withColumn("_last", last).filter(F.col("dt") > F.add_months("_last", -months)).drop("_last", "i", "n"))


def from_wide(wide: DataFrame, tickers: list[str], fields: tuple[str, ...] = ("open", "high", "low", "close", "adj_close", "volume")) -> DataFrame:
    """Long bars from one row for each date with a column ticker_field for each ticker and field."""
    cells = [F.struct(F.lit(t).alias("symbol"), *[F.col(f"`{t}_{f}`").cast("double").alias(f) for f in fields]) for t in tickers]
    return wide.select("dt", F.inline(F.array(*cells))).select("symbol", "dt", *fields)


def repaired(x: str, order: str = "i") -> Column:
    """A price column without gaps: an inner gap of one takes the mean of its neighbours (2 digits), the head of a longer one and the
    end take the last price before, the start takes the first price after. NaN counts as a gap."""
    w = Window.partitionBy("symbol").orderBy(order)
    v = F.nanvl(F.col(x), F.lit(None).cast("double"))
    before = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    prev, following = F.lag(v).over(w), F.lead(v).over(w)
    # within a longer gap all rows but the last repeat the price before it; the last has a repaired neighbour and a real one
    return F.coalesce(v, F.when(before.isNull(), after).when(following.isNotNull(), F.bround(F.round((F.coalesce(prev, before) + following) / 2, 6), 2)).otherwise(before))


def repair(bars: DataFrame) -> DataFrame:
    """bars with all prices repaired, plus n_repaired, how many prices of a row were missing."""
    fixed = {f"_{c}": repaired(c) for c in PRICES}
    missing = sum(F.nanvl(F.col(c), F.lit(None).cast("double")).isNull().cast("int") for c in PRICES)
    out = bars.withColumns(fixed | {"n_repaired": missing})
    return out.withColumns({c: F.col(f"_{c}") for c in PRICES}).drop(*fixed)


def repair_log(bars: DataFrame) -> DataFrame:
    """How many rows of each symbol were repaired, and where."""
    rows = repair(bars).withColumn("status", F.when(F.col("n_repaired") > 0, "repaired").otherwise("complete"))
    return rows.groupBy("symbol", "status").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("n_repaired") > 0, F.col("i")))).alias("at"))


def invalid(bars: DataFrame) -> DataFrame:
    """Symbols that can't be analysed: no close in some row after repair."""
    return repair(bars).groupBy("symbol").agg(F.count_if(F.isnull("close") | F.isnan("close")).alias("n_missing"), F.count("*").alias("n_rows")).filter("n_missing > 0 or n_rows = 0")


def aligned(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every symbol on every dt of calendar: missing rows are inserted and repaired, other dates go."""
    dates = calendar.select("dt").distinct()
    symbols = bars.select("symbol").distinct()
    # one row of dates for each symbol is the result itself: the calendar goes along as one array, bounded by its own length
    days = dates.agg(F.array_sort(F.collect_list("dt")).alias("days"))
    grid = symbols.join(F.broadcast(days)).select("symbol", F.explode("days").alias("dt"))
    return repair(numbered(grid.join(bars.drop("i", "n"), ["symbol", "dt"], "left")))


def calendar_of(bars: DataFrame, interval: str = "1 month") -> DataFrame:
    """dt of every period from the first to the last bar, whether or not a symbol has one."""
    ends = bars.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return ends.filter("a is not null").select(F.explode(F.expr(f"sequence(a, b, interval {interval})")).alias("dt"))


def inserted(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows that aligned() inserts: symbol, i (the place in the aligned series) and dt, for dates of calendar without a bar."""
    have = bars.select("symbol", "dt")
    return aligned(bars, calendar).select("symbol", "i", "dt").join(have, ["symbol", "dt"], "left_anti").select("symbol", "i", "dt")


def symbols_of(bars: DataFrame) -> DataFrame:
    return bars.select(F.upper("symbol").alias("symbol")).distinct()


def one_fund(bars: DataFrame, symbol: str) -> DataFrame:
    """One symbol's bars; the filter reaches the scan where bars are stored."""
    return bars.filter(F.col("symbol") == symbol)
