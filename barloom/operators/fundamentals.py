"""Fundamentals: statements in long form (symbol, statement, item, dt, value), ratios, and analysts' grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ratio

# Grades from best (0) to worst (4); any other word counts as 3.
GRADES = {"Strong Buy": 0, "Buy": 1, "Outperform": 1, "Overweight": 1, "Positive": 1, "Hold": 2, "Neutral": 2, "Market Perform": 2, "Equal-Weight": 2, "Sector Perform": 2, "Underperform": 3, "Underweight": 3, "Sell": 4}


def statement(statements: DataFrame, name: str) -> DataFrame:
    """One statement with a column for each of its items, by symbol and date."""
    return statements.filter(F.col("statement") == name).groupBy("symbol", "dt").pivot("item").agg(F.first("value", ignorenulls=True))


def altman_z(statements: DataFrame, market_caps: DataFrame) -> DataFrame:
    """Z score and its colour from the latest value of each item that isn't missing; market_caps: symbol, market_cap.

    Working capital enters as the ratio of current assets to current liabilities.
    """
    items = {"ta": "Total Assets", "ca": "Current Assets", "cl": "Current Liabilities", "re": "Retained Earnings", "ebit": "EBIT", "rev": "Total Revenue"}
    value = F.nanvl("value", F.lit(None).cast("double"))
    latest = statements.groupBy("symbol").agg(*[F.max_by(value, F.when((F.col("item") == item) & value.isNotNull(), F.col("dt"))).alias(k) for k, item in items.items()])
    df = latest.join(market_caps, "symbol")
    z = ratio(ratio("ca", "cl"), "ta") * 1.2 + ratio("re", "ta") * 1.4 + ratio("ebit", "ta") * 3.3 + ratio("market_cap", "cl") * 0.6 + ratio("rev", "ta")
    return df.select("symbol", F.round(z, 4).alias("z"), F.when(z >= 3.0, "green").when(z > 1.8, "yellow").when(z.isNotNull(), "red").alias("colour"))


def earnings_per_share(earnings: DataFrame, shares: DataFrame, digits: int | None = 3) -> DataFrame:
    """earnings (symbol, period, earnings) over shares (symbol, shares), three digits, or unrounded if digits is None."""
    eps = ratio("earnings", "shares")
    return earnings.join(shares, "symbol").select("symbol", "period", (eps if digits is None else F.bround(eps, digits)).alias("eps"))


def grade_number(grade: str) -> F.Column:
    out = F.lit(None).cast("int")
    for word, n in GRADES.items():
        out = F.when(F.col(grade) == word, F.lit(n)).otherwise(out)
    return F.coalesce(out, F.lit(3))


def recommendation_curve(grades: DataFrame) -> DataFrame:
    """By symbol and date of a grade: the mean of the firms' last grades, a firm's grade lasting two years at most.

    grades: symbol, dt, firm, grade. A grade holds from its date until the firm's next one or two years on, whichever is first;
    each is turned into a step up and a step down, so that no date is joined with all grades before it.
    """
    w = Window.partitionBy("symbol", "firm").orderBy("dt")
    held = grades.withColumn("g", grade_number("grade")).groupBy("symbol", "firm", "dt").agg(F.max("g").alias("g"))
    held = held.withColumn("end", F.least(F.lead("dt").over(w), F.add_months("dt", 24)))
    steps = held.select("symbol", "dt", F.col("g").alias("g"), F.lit(1).alias("k"), F.lit(True).alias("own")).union(held.select("symbol", "end", -F.col("g"), F.lit(-1), F.lit(False)))
    by_date = steps.groupBy("symbol", "dt").agg(F.sum("g").alias("g"), F.sum("k").alias("k"), F.max("own").alias("own"))
    run = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    out = by_date.withColumns({"total": F.sum("g").over(run), "firms": F.sum("k").over(run)}).filter("own")
    return out.select("symbol", "dt", "firms", F.round(F.col("total") / F.col("firms"), 4).alias("mean_grade"))
