"""Company arithmetic and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import by, rolling, safe_div


def wacc(equity: Column, debt: Column, cost_equity: Column, cost_debt: Column, tax: Column) -> Column:
    whole = equity + debt
    return safe_div(equity, whole) * cost_equity + safe_div(debt, whole) * cost_debt * (1 - tax)


def economic_profit(roic: Column, cost: Column, capital: Column) -> Column:
    return (roic - cost) * capital


def incremental_roic(profit: str, capital: str, w: WindowSpec, n: int) -> Column:
    return safe_div(F.col(profit) - F.lag(profit, n).over(w), F.col(capital) - F.lag(capital, n).over(w))


def dupont(income: Column, sales: Column, assets: Column, equity: Column) -> tuple[Column, Column, Column, Column]:
    """Margin, turnover, leverage and their product."""
    a, b, c = safe_div(income, sales), safe_div(sales, assets), safe_div(assets, equity)
    return a, b, c, a * b * c


def capitalised(spend: str, w: WindowSpec, n: int = 60) -> Column:
    """Sum of the last n rows, all of them needed."""
    return rolling(F.sum(spend), spend, w, n)


def regimes(df: DataFrame, value: str, n: int = 12) -> DataFrame:
    """df(date, value) with three readings: level (High above the median, else Low), trend (Rising above the mean of the
    last n rows, else Falling) and regime, the level joined with the direction of the change over n rows, Unknown without
    one."""
    middle = df.agg(F.median(value).alias("__m"))
    w = by(order="date")
    moved = F.col(value) - F.lag(value, n).over(w)
    mean = rolling(F.avg(value), value, w, n)
    d = df.join(F.broadcast(middle)).withColumn("level", F.when(F.col(value) > F.col("__m"), "High").otherwise("Low"))
    d = d.withColumn("trend", F.when(F.col(value) > mean, "Rising").otherwise("Falling"))
    way = F.when(moved > 0, " & Rising").when(moved <= 0, " & Falling")
    return d.withColumn("regime", F.coalesce(F.concat("level", way), F.lit("Unknown"))).drop("__m")


def by_regime(returns: DataFrame, regime: DataFrame, r: str = "r", periods: int = 12) -> DataFrame:
    """(regime, n, annual, volatility, sharpe) of the returns on the regime's dates."""
    g = returns.join(regime, "date").groupBy("regime").agg(F.count(r).alias("n"), (F.avg(r) * periods).alias("annual"), (F.stddev_samp(r) * periods**0.5).alias("volatility"))
    return g.withColumn("sharpe", F.when(F.col("volatility") > 0, F.col("annual") / F.nullif("volatility", F.lit(0.0))))


def history_percentile(df: DataFrame, value: str, keys: list[str], least: int = 10) -> DataFrame:
    """Per key, the latest value and the share of its history below it, if there are more than `least` rows."""
    g = df.withColumn("__now", F.max_by(value, "date").over(by(*keys)))
    share = F.avg((F.col(value) < F.col("__now")).cast("int")) * 100
    return g.groupBy(*keys).agg(F.max("__now").alias("now"), F.when(F.count(value) > least, share).alias("percentile"))
