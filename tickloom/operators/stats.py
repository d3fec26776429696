"""Aggregates: descriptive statistics, correlation, risk, factor validation, claim scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, average_rank, by, change, kurtosis, safe_div, skewness

EPSILON = 1e-15
#: Quantiles of the standard normal distribution for the usual confidence levels.
NORMAL = {0.90: -1.2815515655446004, 0.95: -1.6448536269514722, 0.99: -2.3263478740408408}


def variance(c: Column | str, ddof: int = 1) -> Column:
    c = as_col(c)
    n = F.count(c)
    return F.when(n > ddof, F.var_pop(c) * n / F.nullif(n - ddof, F.lit(0)))


def describe(c: Column | str) -> dict[str, Column]:
    """The twelve fields of a description."""
    c = as_col(c)
    quartile = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return {
        "n": F.count(c), "mean": F.avg(c), "median": quartile[1], "std": F.stddev_samp(c), "var": F.var_samp(c), "min": F.min(c), "max": F.max(c),
        "q25": quartile[0], "q50": quartile[1], "q75": quartile[2], "skew": skewness(c), "kurt": kurtosis(c),
    }


def percent_below(c: Column | str, x: Column | float) -> Column:
    """Share of values strictly below x, in percent."""
    return F.avg((as_col(c) < x).cast("int")) * 100


def pearson(a: Column, b: Column) -> Column:
    """Missing without spread on either side."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))


def correlations(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, pearson, spearman) over rows where both are there."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.withColumn("ra", average_rank(a, *keys)).withColumn("rb", average_rank(b, *keys))
    return d.groupBy(*keys).agg(pearson(F.col(a), F.col(b)).alias("pearson"), pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def _inversions(y: np.ndarray) -> int:
    """Pairs of places whose values fall, by merging sorted blocks of doubling width."""
    y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    n, out, width = len(y), 0, 1
    place = np.arange(n)
    while width < n:
        block = place // (2 * width)
        left = place % (2 * width) < width
        key = block * (n + 1) + y
        ends = np.minimum(block[~left] * width + width, left.sum())  # left values up to the end of the block
        out += int((ends - np.searchsorted(key[left], key[~left], side="right")).sum())
        y = np.sort(key) % (n + 1)
        width *= 2
    return out


def _concordance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over all pairs: concordant less discordant ones, those that differ in a, those that differ in b."""

    def tied(*columns: np.ndarray) -> int:
        n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
        return int((n * (n - 1) // 2).sum())

    pairs, ta, tb, both = len(a) * (len(a) - 1) // 2, tied(a), tied(b), tied(a, b)
    falling = _inversions(b[np.lexsort((b, a))])  # ties in a rise in b, so none of them counts
    return np.array([pairs - ta - tb + both - 2 * falling, pairs - ta, pairs - tb])


def kendall(df: DataFrame, a: str, b: str, row: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tau): tau-b over all pairs of rows of each group, by merge counting inside one series; rows of one `row` make
    no pair. Without keys one row."""
    x = df.select(*keys, F.struct(F.col(row).alias("i"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).alias("x"))
    x = x.where(F.col("x.i").isNotNull() & F.col("x.a").isNotNull() & F.col("x.b").isNotNull() & ~F.isnan("x.a") & ~F.isnan("x.b"))

    @F.pandas_udf("double")
    def tau(i: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for place, p, q in zip(i, x, y, strict=True):
            if len(p) < 2:
                out.append(None)
                continue
            place, p, q = np.asarray(place), np.asarray(p, dtype=float), np.asarray(q, dtype=float)
            s = _concordance(p, q)
            values, at, n = np.unique(place, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(n > 1):
                s = s - _concordance(p[at == k], q[at == k])
            out.append(s[0] / math.sqrt(s[1] * s[2]) if s[1] and s[2] else None)
        return pd.Series(out, dtype="float64")

    held = x.groupBy(*keys).agg(F.collect_list("x").alias("x"))
    return held.select(*keys, F.nanvl(tau(F.transform("x", lambda r: F.xxhash64(r["i"])), F.col("x.a"), F.col("x.b")), F.lit(None).cast("double")).alias("tau"))


def correlation_matrix(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Long (a, b, corr), pairwise complete, by a self-join on the key."""
    x = df.select(key, F.col(name).alias("a"), F.col(value).alias("x")).dropna()
    y = df.select(key, F.col(name).alias("b"), F.col(value).alias("y")).dropna()
    return x.join(y, key).groupBy("a", "b").agg(pearson(F.col("x"), F.col("y")).alias("corr"))


def beta(y: Column | str, x: Column | str, floor: float = 0.0) -> Column:
    """Covariance over variance of the pairs; missing below two pairs or a variance not above the floor."""
    y, x = as_col(y), as_col(x)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    v = F.var_samp(x)
    return F.when((F.count(x) >= 2) & (v > floor), F.covar_samp(y, x) / F.nullif(v, F.lit(0.0)))


def _signed_limit(x: Column) -> Column:
    """Infinity of the sign of x, missing near zero."""
    return F.when(x > EPSILON, float("inf")).when(x < -EPSILON, float("-inf"))


def volatility(r: Column | str, periods: int = 252) -> Column:
    s = F.stddev_samp(as_col(r))
    return F.when(s < EPSILON, 0.0).otherwise(s * math.sqrt(periods))


def sharpe(r: Column | str, rf: float = 0.0, periods: int = 252) -> Column:
    r = as_col(r)
    excess, s = F.avg(r - rf / periods), F.stddev_samp(r - rf / periods)
    return F.when(s < EPSILON, _signed_limit(excess)).otherwise(excess / F.nullif(s, F.lit(0.0)) * math.sqrt(periods))


def downside_deviation(r: Column | str, periods: int = 252) -> Column:
    """Sample deviation of the negative returns alone; zero for at most one of them."""
    r = as_col(r)
    s = F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0))
    return F.when(s < EPSILON, 0.0).otherwise(s * math.sqrt(periods))


def sortino(r: Column | str, rf: float = 0.0, periods: int = 252) -> Column:
    r = as_col(r)
    excess, s = F.avg(r) - rf / periods, F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0))
    return F.when(s < EPSILON, _signed_limit(excess)).otherwise(excess / F.nullif(s, F.lit(0.0)) * math.sqrt(periods))


def drawdowns(df: DataFrame, r: str, keys: list[str], order: str = "date") -> DataFrame:
    """df with `level` (compounded, no starting one) and `drawdown` from the running maximum of levels. Sums of logs, or,
    in a group with a return of -100 % or less, a fold over the ordered returns."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.min(r).over(Window.partitionBy(*keys)) > -1
    logs = F.exp(F.sum(F.log1p(F.when(F.col(r) > -1, F.col(r)))).over(w))
    fold = F.aggregate(F.collect_list(r).over(w), F.lit(1.0), lambda a, x: a * (1 + x))
    d = df.where(F.col(r).isNotNull()).withColumn("level", F.when(ok, logs).otherwise(fold))
    top = F.max("level").over(w)
    return d.withColumn("drawdown", safe_div(F.col("level") - top, top))


def value_at_risk(r: Column | str, confidence: float = 0.95, parametric: bool = False) -> Column:
    r = as_col(r)
    if parametric:
        return F.avg(r) + NORMAL[confidence] * F.stddev_samp(r)
    return F.percentile(r, F.lit(round(1 - confidence, 10)))


def treynor(r: Column | str, b: Column | str, rf: float = 0.0, periods: int = 252) -> Column:
    """Annualised excess over beta; the mean is that of all the returns, aligned or not."""
    excess, k = F.avg(as_col(r)) * periods - rf, beta(r, b, EPSILON)
    return F.when(F.abs(k) < EPSILON, _signed_limit(excess)).otherwise(excess / F.nullif(k, F.lit(0.0)))


def information_ratio(r: Column | str, b: Column | str, periods: int = 252) -> Column:
    a = as_col(r) - as_col(b)
    m, s = F.avg(a), F.stddev_samp(a)
    return F.when(s < EPSILON, _signed_limit(m)).otherwise(m / F.nullif(s, F.lit(0.0)) * math.sqrt(periods))


def attribution(df: DataFrame, r: str, factors: list[str], keys: list[str], least: int = 5) -> DataFrame:
    """Beta on each factor by itself; mean and R2 of what is left after the first factor only."""
    d = df.where(" and ".join(f"{c} is not null" for c in (r, *factors)))
    betas = {f"{f}_beta": F.when(F.count(r) >= least, beta(r, f)) for f in factors}
    g = d.groupBy(*keys).agg(
        *[b.alias(n) for n, b in betas.items()], F.count(r).alias("n"), F.avg(r).alias("mr"), F.avg(factors[0]).alias("mf"),
        F.var_samp(r).alias("vr"), F.var_samp(factors[0]).alias("vf"), F.covar_samp(r, factors[0]).alias("crf"),
    )
    b = F.col(f"{factors[0]}_beta")
    left = F.col("vr") - 2 * b * F.col("crf") + b * b * F.col("vf")
    return g.select(*keys, *betas, (F.col("mr") - b * F.col("mf")).alias("residual_return"), F.when(F.col("n") >= least, 1 - safe_div(left, "vr")).alias("r_squared"))


def quantile_returns(df: DataFrame, bins: str, forward: str) -> DataFrame:
    """(bin, mean): the mean over dates of each date's mean."""
    daily = df.where(F.col(bins).isNotNull() & F.col(forward).isNotNull()).groupBy("date", bins).agg(F.avg(forward).alias("m"))
    return daily.groupBy(F.col(bins).alias("bin")).agg(F.avg("m").alias("mean"))


def long_short(means: DataFrame, n: int) -> DataFrame:
    """One row from quantile_returns(): top minus bottom, and monotonicity (Spearman of bin and mean, moved to 0..1)."""
    ranked = means.withColumn("rank", average_rank("mean"))
    rho = pearson(F.col("bin").cast("double"), F.col("rank"))
    top, bottom = (F.max(F.when(F.col("bin") == b, F.col("mean"))) for b in (n, 1))
    return ranked.agg((top - bottom).alias("long_short"), ((rho + 1) / 2).alias("monotonicity"))


def ic_series(df: DataFrame, factor: str, forward: str, rank: bool = True, least: int = 5) -> DataFrame:
    """(date, ic): correlation, of ranks or values, across symbols on each date with enough of them."""
    d = df.where(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    a, b = F.col(factor), F.col(forward)
    if rank:
        d = d.withColumn("__a", average_rank(factor, "date")).withColumn("__b", average_rank(forward, "date"))
        a, b = F.col("__a"), F.col("__b")
    return d.groupBy("date").agg(F.when(F.count(a) >= least, pearson(a, b)).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    ir = m / F.nullif(s, F.lit(0.0))
    return ics.agg(m.alias("mean_ic"), s.alias("std_ic"), ir.alias("ir"), (ir * F.sqrt(n)).alias("t_stat"), n.alias("n"), F.avg((F.col("ic") > 0).cast("int")).alias("positive"))


def student_p_value(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    if df <= 0 or t is None:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x > 0 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def winsorised_mean(df: DataFrame, c: str, keys: list[str], low: float, high: float, deviation: bool = False) -> DataFrame:
    """(keys, mean[, std]) of values clipped to their group's quantiles."""
    edges = df.groupBy(*keys).agg(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias("e"))
    j = df.join(edges, keys).where(F.col(c).isNotNull())
    x = F.greatest(F.col("e")[0], F.least(F.col("e")[1], F.col(c)))
    aggs = [F.avg(x).alias("mean")] + ([F.stddev_samp(x).alias("std")] if deviation else [])
    return j.groupBy(*keys).agg(*aggs)


def coverage(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), F.count(c).alias("present"), F.count_if(F.col(c).isNull()).alias("absent"), (F.count(c) / n).alias("coverage"))


def best_worst(df: DataFrame, name: str, value: str, keys: list[str]) -> DataFrame:
    """Best and worst by value, ties to the first name; and the average."""
    d = df.where(F.col(value).isNotNull())
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    worst = F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
    return d.groupBy(*keys).agg(best["n"].alias("best"), worst["n"].alias("worst"), F.avg(value).alias("average"))


def freshness(df: DataFrame) -> DataFrame:
    """(symbol, date, is_newest, is_oldest, gap_days) of each symbol's latest date."""
    last = df.groupBy("symbol").agg(F.max("date").alias("date"))
    ends = last.agg(F.max("date").alias("newest"), F.min("date").alias("oldest"))  # one row
    each = last.join(F.broadcast(ends))
    return each.select("symbol", "date", (F.col("date") == F.col("newest")).alias("is_newest"), (F.col("date") == F.col("oldest")).alias("is_oldest"), F.date_diff("newest", "date").alias("gap_days"))


def claim_scores(claims: DataFrame, boost: float = 0.10, bar: float = 0.7) -> DataFrame:
    """claims(ticker, confidence, claim_type, rules) -> (ticker, score, claims, structural). Weights: 2 under rule_11,
    1.5 under rule_6, else 1; a growth claim is raised from the bar on and lowered below it."""
    w = F.when(F.array_contains("rules", "rule_11"), 2.0).when(F.array_contains("rules", "rule_6"), 1.5).otherwise(1.0)
    x = F.when(F.col("claim_type") == "cagr_connection", F.col("confidence") * F.when(F.col("confidence") >= bar, 1 + boost).otherwise(1 - boost)).otherwise(F.col("confidence"))
    structural = F.arrays_overlap("rules", F.array(F.lit("rule_6"), F.lit("rule_11")))
    g = claims.groupBy("ticker").agg(F.sum(w * x).alias("s"), F.sum(w).alias("w"), F.sum(F.when(structural, w).otherwise(0.0)).alias("t"), F.count("*").alias("claims"))
    return g.select("ticker", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("w"))).alias("score"), "claims", (F.col("t") / F.col("w")).alias("structural"))


def price_summary(df: DataFrame, keys: list[str], band: float = 10.0, calm: float = 3.0) -> DataFrame:
    """Range, mean, deviation, change from first to last; trend beyond a band; volatile if more than 20 prices have
    changes that deviate by more than `calm` percent."""
    df = df.withColumn("__r", change("close", 1, by(*keys, order="date")))
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    pct = safe_div(last - first, first) * 100
    g = df.groupBy(*keys).agg(F.min("close").alias("low"), F.max("close").alias("high"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"), (last - first).alias("change"), pct.alias("pct"), ((F.count("close") > 20) & (F.coalesce(F.stddev_samp("__r"), F.lit(0.0)) * 100 > calm)).alias("volatile"))
    return g.withColumn("trend", F.when(F.col("pct") > band, "up").when(F.col("pct") < -band, "down").otherwise("stable"))


def top_share(df: DataFrame, c: str, share: float, tie: str) -> DataFrame:
    """The best round(share * n) rows by c, at least one (halves to even), ties by `tie`. Approximate quantiles bracket
    the cut: rows above the bracket are in, and only rows inside it, about a five-thousandth, are sorted."""
    d = df.where(F.col(c).isNotNull())
    edges = F.percentile_approx(c, F.array(F.lit(max(0.0, 1 - share - 1e-4)), F.lit(min(1.0, 1 - share + 1e-4))), 10_000)
    r = d.agg(F.count("*").alias("n"), edges.alias("e")).first()
    if not r["n"]:
        return d
    wanted = max(1, round(r["n"] * share))
    low, high = r["e"]
    # approximation may put either edge on the wrong side of the cut by a few rows
    above = {x: d.where(F.col(c) > x).count() for x in (low, high)}
    high = high if above[high] <= wanted else None
    low = low if above[low] + d.where(F.col(c) == low).count() >= wanted else None
    inside = d if low is None else d.where(F.col(c) >= low)
    sure = d.limit(0) if high is None else d.where(F.col(c) > high)
    n = 0 if high is None else above[high]
    rest = inside if high is None else inside.where(F.col(c) <= high)
    return sure.unionByName(rest.orderBy(F.desc(c), tie).limit(wanted - n))


def overall_rank(df: DataFrame, c: str, out: str, buckets: int = 200) -> DataFrame:
    """df with the average rank of c over all rows. Values are counted, dealt into ranges by approximate quantiles, and
    summed up within each range on top of the ranges before, so no task sees all rows, however many share a value."""
    d = df.where(F.col(c).isNotNull())
    edges = d.agg(F.percentile_approx(c, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000)).first()[0] or []
    edges = sorted(set(edges))
    values = d.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("n")).withColumn("k", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col("__v"))))
    sizes = {r["k"]: r["n"] for r in values.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most `buckets` rows
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    first = F.get(F.array(*[F.lit(before.get(k, 0)) for k in range(len(edges) + 1)]), F.col("k"))
    up_to = F.sum("n").over(Window.partitionBy("k").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.select("__v", (first + up_to - (F.col("n") - 1) / 2).alias(out))
    return df.join(ranks, F.col(c) == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the average ranks over rows where both are there."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = overall_rank(overall_rank(d, "a", "ra"), "b", "rb")
    return d.agg(pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def hit_rate(df: DataFrame, a: str, b: str, key: str, share: float = 0.2) -> DataFrame:
    """One row: the overlap of the two top sets over the size of the first."""
    x, y = top_share(df, a, share, key).select(key), top_share(df, b, share, key).select(key)
    return x.join(y.withColumn("hit", F.lit(1)), key, "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("rate"))


