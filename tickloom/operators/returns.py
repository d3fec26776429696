"""Period returns, lag families, growth and signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import as_col, by, change, filled, safe_div
from .indicators import log_return, rsi, sma


def margin_delta(c: str, w: WindowSpec, n: int, per_year: int = 12) -> Column:
    """Difference over n rows, a year."""
    return (F.col(c) - F.lag(c, n).over(w)) / (n / per_year)


def margin_improvement(c: str, w: WindowSpec, n: int) -> Column:
    """Share of the room up to 100 that was gained."""
    before = F.lag(c, n).over(w)
    return safe_div(F.col(c) - before, 100 - before)


def shifted(c: str, w: WindowSpec, back: tuple[int, ...], ahead: tuple[int, ...] = ()) -> dict[str, Column]:
    """Lag and lead columns by name, as c_3m_ago and c_1m_ahead."""
    out = {f"{c}_{n}m_ago": F.lag(c, n).over(w) for n in back}
    return out | {f"{c}_{n}m_ahead": F.lead(c, n).over(w) for n in ahead}


def month_ends(df: DataFrame) -> DataFrame:
    """The last value of each month, on a gapless list of months per symbol."""
    last = df.groupBy("symbol", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    span = last.groupBy("symbol").agg(F.trunc(F.min("month"), "month").alias("a"), F.trunc(F.max("month"), "month").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select("symbol", F.last_day("m").alias("month"))
    return grid.join(last, ["symbol", "month"], "left")


def interval_returns(df: DataFrame, spans: tuple[int, ...], shape: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    w = by("symbol", order="month")
    return month_ends(df).select("symbol", "month", *[shape(change("close", n, w)).alias(f"ret_{n}m") for n in spans])


def period_table(df: DataFrame, shape: Callable[[Column], Column] = lambda c: c, rows: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """Latest return over n rows, and since the first price inside the month, the year, and the six days before the
    latest date's weekday count (the previous Tuesday rule). Rows without a price don't count."""
    df = df.where("close is not null")
    last = F.max("date").over(by("symbol"))
    back = F.row_number().over(by("symbol").orderBy(F.desc("date")))
    d = df.withColumn("k", back).withColumn("last", last)
    tuesday = F.date_sub("last", F.weekday("last") + 6)

    def first_since(day: Column) -> Column:
        return F.min_by("close", F.when(F.col("date") >= day, F.col("date")))

    g = d.groupBy("symbol").agg(
        F.max(F.when(F.col("k") == 1, F.col("close"))).alias("now"),
        *[F.max(F.when(F.col("k") == n + 1, F.col("close"))).alias(f"p{n}") for n in rows],
        first_since(F.trunc("last", "month")).alias("mtd"),
        first_since(F.trunc("last", "year")).alias("ytd"),
        first_since(tuesday).alias("tuesday"),
    )
    ends = [(f"ret_{n}d", f"p{n}") for n in rows] + [("ret_mtd", "mtd"), ("ret_ytd", "ytd"), ("ret_tuesday", "tuesday")]
    return g.select("symbol", *[shape(safe_div("now", c) - 1).alias(n) for n, c in ends])


def since_previous_end(df: DataFrame, shape: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Return from the last price of the previous month and year, simple and as a log. Rows without a price don't count."""
    d = df.where("close is not null").withColumn("last", F.max("date").over(by("symbol")))

    def end_before(unit: str) -> Column:
        return F.max_by("close", F.when(F.col("date") < F.trunc("last", unit), F.col("date")))

    g = d.groupBy("symbol").agg(F.max_by("close", "date").alias("now"), end_before("month").alias("m"), end_before("year").alias("y"))
    year = safe_div("now", "y")
    return g.select("symbol", shape(safe_div("now", "m") - 1).alias("mtd"), shape(year - 1).alias("ytd"), shape(F.ln(year)).alias("ytd_log"))


def signals(df: DataFrame, fast: int, slow: int, lookback: int, period: int = 14, overbought: float = 70.0, oversold: float = 30.0) -> DataFrame:
    """(symbol, date, trend, momentum, rsi_signal): trend is 1 or -1 by the moving averages and 0 where they are equal or
    missing; momentum the padded return over `lookback` rows; the strength signal 1 when oversold, -1 when overbought,
    else 0. A series shorter than a signal's window has none of it."""
    w = by("symbol", order="date")
    n = F.count("*").over(by("symbol"))
    d = df.select("symbol", "date", "close", n.alias("n"), filled("close", w).alias("padded"))
    d = d.select("*", sma("close", w, fast).alias("f"), sma("close", w, slow).alias("s"), change("padded", lookback, w).alias("m"))
    d = rsi(d, "close", period)
    n, f, s = F.col("n"), F.col("f"), F.col("s")
    trend = F.when(n < slow, None).when(f > s, 1.0).when(f < s, -1.0).otherwise(0.0)
    strength = F.when(n < period, None).when(F.col("rsi") < oversold, 1.0).when(F.col("rsi") > overbought, -1.0).otherwise(0.0)
    return d.select("symbol", "date", trend.alias("trend"), F.when(n >= lookback, F.col("m")).alias("momentum"), strength.alias("rsi_signal"))


def lag_slope(df: DataFrame, c: str, n: int, shape: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Least-squares slope over the value and its n - 1 lags, at least two of them; closed form, in one window pass."""
    w = by("symbol", order="date")
    ys = [F.col(c) if k == 0 else F.lag(c, k).over(w) for k in range(n)]
    d = df.select("symbol", "date", F.array(*ys).alias("ys"))
    pairs = F.filter(F.transform("ys", lambda y, i: F.struct((-i).cast("double").alias("x"), y.alias("y"))), lambda p: p["y"].isNotNull())

    def total(f) -> Column:
        return F.aggregate("pairs", F.lit(0.0), lambda a, p: a + f(p))

    d = d.withColumn("pairs", pairs).withColumn("k", F.size("pairs"))
    d = d.withColumn("mx", safe_div(total(lambda p: p["x"]), "k")).withColumn("my", safe_div(total(lambda p: p["y"]), "k"))
    sxy = total(lambda p: (p["x"] - F.col("mx")) * (p["y"] - F.col("my")))
    sxx = total(lambda p: (p["x"] - F.col("mx")) * (p["x"] - F.col("mx")))
    return d.select("symbol", "date", shape(F.when(F.col("k") >= 2, safe_div(sxy, sxx))).alias("slope"))


def log_table(c: str, w: WindowSpec, months: tuple[int, ...]) -> list[Column]:
    return [log_return(as_col(c), w, m).alias(f"log_{m}m") for m in months]
