"""Portfolios and simulations: synthetic funds, ledgers, dividends, trading strategies, retirement scenarios."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import by_symbol, lag, ratio
from ..sources.files import read_head, register
from .cross import returns
from .oscillators import cluster_oscillators

CASH = "xCASHx"


def synthetic_fund(bars: DataFrame, weights: DataFrame, price: str = "close", start: float = 25.0, drift: float = 0.01) -> DataFrame:
    """By fund and date: weighted returns of its symbols compounded from start. weights: fund, symbol, weight; the symbol xCASHx
    earns drift over half the rows of the fund."""
    priced = returns(bars.withColumn("close", F.col(price))).select("symbol", "dt", F.col("ret") / 100.0)
    priced = priced.toDF("symbol", "dt", "r")
    parts = priced.join(weights.filter(F.col("symbol") != CASH), "symbol").groupBy("fund", "dt").agg(F.sum(F.col("r") * F.col("weight")).alias("r"))
    cash = weights.filter(F.col("symbol") == CASH).groupBy("fund").agg(F.sum("weight").alias("cash"))
    df = parts.join(cash, "fund", "left").withColumn("n", F.count("*").over(Window.partitionBy("fund")))
    df = df.withColumn("r", F.col("r") + F.coalesce("cash", F.lit(0.0)) * (F.lit(drift) / F.col("n") / 2.0))
    w = Window.partitionBy("fund").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("fund", "dt", (F.lit(start) * F.exp(F.sum(F.log1p(F.greatest(F.col("r"), F.lit(-0.99)))).over(w))).alias("value"))


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Trades of a ledger file (stock, action, price, dt, amount, shares) and its header: title, start capital, ticker.

    The header alone is read on the driver.
    """
    register(spark)
    trades = spark.read.format("ledger").load(path).select("stock", "action", "price", "dt", "amount", "shares")
    return trades, read_head(path)


def ledger_simulation(trades: DataFrame, bars: DataFrame, start_cash: float = 1_000_000.0) -> DataFrame:
    """By date: value of all holdings at the close, cash, and their total. trades: stock, action, price, dt, shares, amount.

    Rows of a stock beginning with _ move cash alone. Trades count on their exact date if the symbol has a bar there. The cash of
    all trades is summed by date before the running sum, which runs over the calendar.
    """
    sign = F.when(F.col("action").isin("Buy", "Withdraw"), -1.0).otherwise(1.0)
    moves = trades.withColumn("_cash", sign * F.coalesce(F.col("price") * F.col("shares"), F.col("amount"))).withColumn("_shares", F.when(F.col("action") == "Buy", F.col("shares")).when(F.col("action") == "Sell", -F.col("shares")).otherwise(0.0))
    stock = moves.filter(~F.col("stock").startswith("_")).groupBy(F.col("stock").alias("symbol"), "dt").agg(F.sum("_shares").alias("s"), F.sum("_cash").alias("c"))
    held = bars.select("symbol", "dt", "close").join(stock, ["symbol", "dt"], "left")
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("shares", F.sum(F.coalesce("s", F.lit(0.0))).over(w))
    by_date = held.groupBy("dt").agg(F.sum(F.col("shares") * F.col("close")).alias("value"), F.sum(F.coalesce("c", F.lit(0.0))).alias("moved"))
    other = moves.filter(F.col("stock").startswith("_")).groupBy("dt").agg(F.sum("_cash").alias("other"))
    all_dates = by_date.join(other, "dt", "left").withColumn("one", F.lit("ledger"))
    run = Window.partitionBy("one").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    cash = F.lit(start_cash) + F.sum(F.col("moved") + F.coalesce("other", F.lit(0.0))).over(run)
    return all_dates.select("dt", "value", cash.alias("cash")).withColumn("total", F.col("value") + F.col("cash"))


def holdings(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Shares of each symbol after all trades, their value at the last close, and the percent of the total, largest first."""
    shares = trades.filter(~F.col("stock").startswith("_")).groupBy(F.col("stock").alias("symbol")).agg(F.sum(F.when(F.col("action") == "Buy", F.col("shares")).when(F.col("action") == "Sell", -F.col("shares")).otherwise(0.0)).alias("shares"))
    last = bars.groupBy("symbol").agg(F.max_by("close", "i").alias("close"))
    df = shares.join(last, "symbol").withColumn("value", F.col("shares") * F.col("close"))
    total = F.broadcast(df.agg(F.sum("value").alias("total")))  # one row
    df = df.join(total).withColumn("percent", F.bround(ratio("value", "total") * 100.0, 2))
    # hundredths of a percent, of which there are ten thousand at most in a portfolio without debts: few rows to rank and to broadcast
    ranks = df.select(F.col("percent").alias("_p")).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("_p"))))
    return df.join(ranks, F.col("percent").eqNullSafe(F.col("_p"))).select("symbol", "shares", "value", "percent", "rank")


def dividends_quarterly(dividends: DataFrame, bars: DataFrame, shares: DataFrame) -> DataFrame:
    """By symbol, year and quarter: sums of dividends paid on the held shares (each rounded), the first close on or after the quarter's
    last day or else the last one, and the yield in percent. dividends: symbol, dt, dividend; shares: symbol, shares."""
    paid = dividends.join(shares, "symbol").withColumn("paid", F.bround(F.col("dividend") * F.col("shares"), 2)).withColumns({"year": F.year("dt"), "quarter": F.quarter("dt")})
    sums = paid.groupBy("symbol", "year", "quarter").agg(F.sum("paid").alias("paid"), F.sum("dividend").alias("dividend"))
    marked = bars.select("symbol", "close", F.year("dt").alias("year"), F.quarter("dt").alias("quarter"), "dt")
    ends = marked.groupBy("symbol", "year", "quarter").agg(F.max_by("close", "dt").alias("last_close"), F.min_by("close", "dt").alias("first_close"))
    ends = ends.withColumn("next_close", F.lead("first_close").over(Window.partitionBy("symbol").orderBy("year", "quarter")))
    out = sums.join(ends, ["symbol", "year", "quarter"], "left").withColumn("price", F.coalesce("next_close", "last_close"))
    return out.select("symbol", "year", "quarter", F.bround("paid", 2).alias("paid"), "price", F.bround(ratio("dividend", "price") * 400.0, 4).alias("yield"))


def buy_and_hold(bars: DataFrame, dividends: DataFrame | None = None, invested: float = 100_000.0) -> DataFrame:
    """Whole shares bought at the first close, cash left, dividends put into shares on their dates, and the final amount."""
    df = bars if dividends is None else bars.join(dividends, ["symbol", "dt"], "left")
    df = df if "dividend" in df.columns else df.withColumn("dividend", F.lit(None).cast("double"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        close = p["close"].to_numpy()
        bought = math.floor(invested / close[0])
        cash, shares = round(invested - bought * close[0], 2), float(bought)
        for c, d in zip(close, p["dividend"], strict=True):
            if d == d and d is not None:
                shares = round(shares * (d / c + 1.0), 3)
        return pd.DataFrame({"symbol": [p["symbol"].iloc[0]], "init_shares": [float(bought)], "cash": [cash], "final_shares": [shares], "final_amount": [round(close[-1] * shares + cash, 2)]})

    return by_symbol(df.select("symbol", "i", "close", "dividend"), run, "symbol string, init_shares double, cash double, final_shares double, final_amount double")


def cluster_strategy(bars: DataFrame, invested: float = 100_000.0, sell_above: float = 0.6, buy_below: float = 0.4, sell_share: float = 0.3, buy_share: float = 1.0, boost: float = 1.2) -> DataFrame:
    """Sell and buy in proportion to how far the clusters are beyond shares of their extremes; whole shares only."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, close = p["clustered"].to_numpy(), p["close"].to_numpy()
        shares = float(math.floor(invested / close[0]))
        cash = round(invested - shares * close[0], 2)
        top, low = x.max(), x.min()
        sell, buy = sell_above * top, buy_below * low
        trades = 0
        for v, c in zip(x, close, strict=True):
            if v > sell and top > sell:
                n = math.floor(shares * sell_share * (v - sell) / (top - sell))
                shares, cash, trades = shares - n, cash + round(n * c, 2), trades + (n > 0)
            if v < buy and low < buy:
                n = math.floor(min(buy_share * (v - buy) / (low - buy) * boost, 1.0) * cash / c)
                shares, cash, trades = shares + n, round(cash - n * c, 2), trades + (n > 0)
        return pd.DataFrame({"symbol": [p["symbol"].iloc[0]], "n_trades": [trades], "cash": [float(cash)], "final_shares": [float(shares)], "final_amount": [round(close[-1] * shares + cash, 2)]})

    return by_symbol(cluster_oscillators(bars, "all").select("symbol", "i", "close", "clustered"), run, "symbol string, n_trades long, cash double, final_shares double, final_amount double")


# --- retirement ----------------------------------------------------------------------------------------------------------------------

# Upper ends and rates of the tax brackets of two years, and life expectancies from the age of 72 on.
BRACKETS = {
    0: ((10275, 0.1), (41775, 0.12), (89075, 0.22), (170050, 0.24), (215950, 0.32), (539900, 0.35), (100000000, 0.37)),
    1: ((11000, 0.1), (44725, 0.12), (95375, 0.22), (182100, 0.24), (231250, 0.32), (578125, 0.35), (100000000, 0.37)),
}
LIFE_EXPECTANCY = (27.4, 26.5, 25.5, 24.6, 23.7, 22.9, 22.0, 21.1, 20.2, 19.4, 18.5, 17.7, 16.8, 16.0, 15.2, 14.4, 13.7, 12.9, 12.2, 11.5, 10.8, 10.1, 9.5, 8.9, 8.4, 7.8, 7.3, 6.8, 6.4)
START_AGE, RMD_AGE = 22, 72


def income_tax(incomes: DataFrame, year: int = 1) -> DataFrame:
    """incomes (a column income) plus tax, over the brackets, and effective_rate in percent."""
    x, low, tax = F.col("income").cast("double"), 0, F.lit(0.0)
    for high, rate in BRACKETS[year]:
        tax = tax + F.greatest(F.least(x, F.lit(float(high))) - float(low), F.lit(0.0)) * rate
        low = high
    df = incomes.withColumn("tax", tax)
    return df.withColumn("effective_rate", F.coalesce(F.bround(ratio(F.bround("tax", 2), x) * 100.0, 2), F.lit(0.0)))


def _least(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return np.where(b < a, b, a)


def _greatest(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return np.where(b > a, b, a)


def _tax(income: np.ndarray, year: int = 1) -> np.ndarray:
    low, total = 0.0, np.zeros(len(income))
    for high, rate in BRACKETS[year]:
        total += _greatest(_least(income, high) - low, 0.0) * rate
        low = high
    return total


def growth_curve(high: np.ndarray, low: np.ndarray, years: int) -> list[np.ndarray]:
    """Growth by year, falling from high to low along a logistic curve."""
    return [(high - low) / (1.0 + math.exp((y - years * 0.6) / 5)) + low for y in range(years)]


def gap_withdrawal(savings: np.ndarray, nominal: np.ndarray, year: int, share: float = 0.04, inflation: float = 0.03) -> np.ndarray:
    """The larger of a share of the savings and the nominal amount, both raised by inflation for each year."""
    return _greatest(savings * share, nominal) * (1.0 + inflation * year)


BALANCES = ("roth", "trad", "brokerage", "savings", "missed", "taxes")


def _retire(s: dict[str, np.ndarray], years: int) -> tuple[list[str], dict[str, np.ndarray]]:
    """Phase by year, and yearly balances (scenario, year) of scenarios of equally many years of work: work, then gap years, then
    years with required withdrawals.

    Withdrawals come from the two accounts by the mix, what one lacks from the other, then from brokerage; taxes on money from the
    traditional account come out of it, then of the others. The required amount is the balance times the expectancy in percent.
    """
    growth = growth_curve(s["growth_high"], s["growth_low"], years)
    gap = max(0, RMD_AGE - (years + START_AGE))
    phases = ["work"] * years + ["gap"] * gap + ["rmd"] * len(LIFE_EXPECTANCY)
    size = len(s["contribution"])
    out = {name: np.empty((size, len(phases))) for name in BALANCES}
    box = {"trad": np.zeros(size), "roth": np.zeros(size), "brokerage": np.zeros(size)}
    missed, taxes = np.zeros(size), np.zeros(size)

    def take(amount: np.ndarray, *order: str) -> None:
        for name in order:
            part = _least(box[name], amount)
            box[name] = box[name] - part
            amount = amount - part

    def year_end(rate: np.ndarray, year: int) -> None:
        for name in box:
            box[name] = box[name] * (1.0 + rate)
        for name, v in zip(BALANCES, (box["roth"], box["trad"], box["brokerage"], box["roth"] + box["trad"], missed, taxes), strict=True):
            out[name][:, year] = v

    roth = s["roth_share"] * s["contribution"]
    missing = _tax(roth)
    for y in range(years):
        missed = (missed + missing) * (1.0 + growth[y])
        box["roth"] = box["roth"] + roth
        box["trad"] = box["trad"] + (1.0 - s["roth_share"]) * s["contribution"]
        year_end(growth[y], y)
    for k, required in enumerate([0.0] * gap + list(LIFE_EXPECTANCY)):
        wanted = gap_withdrawal(box["roth"] + box["trad"], s["withdrawal"], k)
        share = np.where(box["roth"] > 0, np.where(box["trad"] > 0, s["roth_share"], 1.0), 0.0)
        due = box["trad"] * required / 100.0
        from_trad = wanted * (1.0 - share)
        more = _greatest(0.0, _least(due, box["trad"]) - from_trad)
        owed = _tax(_least(from_trad + more, box["trad"]))
        take(from_trad + more, "trad", "roth", "brokerage")
        take(wanted * share, "roth", "trad", "brokerage")
        box["brokerage"] = box["brokerage"] + more
        take(owed, "trad", "brokerage", "roth")
        taxes = taxes + owed
        year_end(growth[-1], years + k)
    return phases, out


RETIREMENT = "scenario long, year int, phase string, roth double, trad double, brokerage double, savings double, missed double, taxes double"
#: Scenarios that are worked out at once.
AT_ONCE = 1000


def retirement(scenarios: DataFrame) -> DataFrame:
    """Yearly balances for a table of scenarios: scenario, contribution, growth_high, growth_low, withdrawal, years_worked, roth_share.

    A scenario makes about eighty rows, so that scenarios are spread over all tasks first, however few files they come from.
    """
    inputs = ("contribution", "growth_high", "growth_low", "withdrawal", "roth_share")
    names = [x.split()[0] for x in RETIREMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worked = np.array(batch.column("years_worked").to_pylist(), dtype=int)
            values = {x: batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in inputs}
            for years in np.unique(worked).tolist():
                own = np.flatnonzero(worked == years)
                for start in range(0, len(own), AT_ONCE):
                    at = own[start : start + AT_ONCE]
                    phases, out = _retire({x: v[at] for x, v in values.items()}, years)
                    scenario = batch.column("scenario").cast(pa.int64()).take(pa.array(np.repeat(at, len(phases))))
                    year = np.tile(np.arange(len(phases), dtype=np.int32), len(at))
                    columns = [scenario, pa.array(year), pa.array(phases, pa.string()).take(pa.array(year))]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(out[x].ravel(), from_pandas=True) for x in BALANCES], names=names)

    return scenarios.repartition("scenario").mapInArrow(run, RETIREMENT)


def scenario_grid(spark: SparkSession, contributions: tuple[float, ...] = (5_000.0, 10_000.0, 20_500.0), mixes: tuple[float, ...] = (0.0, 0.5, 1.0), growths: tuple[tuple[float, float], ...] = ((0.09, 0.05),), withdrawal: float = 60_000.0, years: int = 43) -> DataFrame:
    """All combinations of contribution, mix and growth: a small table that the parameters bound."""
    rows = [(float(c), g[0], g[1], withdrawal, years, m) for c in contributions for m in mixes for g in growths]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "scenario long, contribution double, growth_high double, growth_low double, withdrawal double, years_worked int, roth_share double")


def contribution_race(scenarios: DataFrame, months: int = 504, switch: int = 120) -> DataFrame:
    """Two savers by month, in closed form: one pays for the first 120 months, the other from then on.

    scenarios: scenario, rate (yearly growth), contribution (yearly).
    """
    g, pay = F.col("rate") / 12.0, F.col("contribution") / 12.0
    df = scenarios.select("*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))

    def saved(n: F.Column) -> F.Column:
        return F.when(g == 0, pay * n).otherwise(pay * (F.pow(g + 1.0, n) - 1.0) / g)

    paid = F.least(F.col("month"), F.lit(switch)).cast("double")
    first = saved(paid) * F.pow(g + 1.0, F.greatest(F.col("month") - switch, F.lit(0)).cast("double"))
    second = saved(F.greatest(F.col("month") - switch, F.lit(0)).cast("double"))
    return df.select("scenario", "month", first.alias("early"), second.alias("late"))


def race_over(bars: DataFrame, switch: int = 24, payment: float = 500.0) -> DataFrame:
    """Two savers over each symbol's own prices: one buys for a payment at each of the first closes, the other at all later ones.

    What they hold in the end is what they paid, grown by the symbol's changes from row to row: symbol, n_rows, early, late.
    """
    bought = F.lit(payment) / F.nullif("close", F.lit(0.0))
    sums = bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max_by("close", "i").alias("_last"), F.sum(F.when(F.col("i") < switch, bought)).alias("_a"), F.sum(F.when(F.col("i") >= switch, bought)).alias("_b"))
    return sums.select("symbol", "n_rows", *[(F.coalesce(x, F.lit(0.0)) * F.col("_last")).alias(name) for x, name in (("_a", "early"), ("_b", "late"))])


def change_of(df: DataFrame, x: str) -> DataFrame:
    """df plus change: x less the row before."""
    return df.withColumn("change", F.col(x) - lag(x))
