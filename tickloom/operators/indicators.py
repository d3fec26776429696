"""Per-symbol indicators on positional rows. Every column function shares one window specification, so that all
indicators of a panel take one exchange and one sort by symbol."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import as_col, by, change, filled, rolling, safe_div, trailing

YEAR_DAYS = 252


def sma(c: Column | str, w: WindowSpec, n: int) -> Column:
    """Mean of the last n rows; the first n - 1 are missing."""
    return rolling(F.avg(as_col(c)), c, w, n)


def simple_return(c: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return change(c, n, w)


def log_return(c: Column | str, w: WindowSpec, n: int = 1) -> Column:
    c = as_col(c)
    ratio = safe_div(c, F.lag(c, n).over(w))
    return F.when(ratio > 0, F.ln(ratio))


def rolling_volatility(r: Column | str, w: WindowSpec, n: int, periods: int = YEAR_DAYS) -> Column:
    return rolling(F.stddev_samp(as_col(r)), r, w, n) * F.sqrt(F.lit(float(periods)))


def bollinger(c: Column | str, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle and lower band."""
    mid, dev = sma(c, w, n), rolling(F.stddev_samp(as_col(c)), c, w, n)
    return mid + k * dev, mid, mid - k * dev


def rolling_correlation(a: Column | str, b: Column | str, w: WindowSpec, n: int, least: int) -> Column:
    a, b = as_col(a), as_col(b)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    frame = trailing(w, n)
    ok = (F.count(both).over(frame) >= least) & (F.var_pop(x).over(frame) > 0) & (F.var_pop(y).over(frame) > 0)
    return F.when(ok, F.corr(x, y).over(frame))


def rolling_beta(y: Column | str, b: Column | str, w: WindowSpec, n: int, least: int) -> Column:
    """Covariance over the pairs divided by the benchmark's variance over its own rows."""
    y, b = as_col(y), as_col(b)
    frame = trailing(w, n)
    pairs = F.count(F.when(y.isNotNull() & b.isNotNull(), 1)).over(frame)
    enough = (pairs >= least) & (F.count(b).over(frame) >= least)
    return F.when(enough, safe_div(F.covar_samp(y, b).over(frame), F.var_samp(b).over(frame)))


def momentum(c: Column | str, w: WindowSpec, lookback: int, skip: int) -> Column:
    c = as_col(c)
    return safe_div(F.lag(c, skip).over(w), F.lag(c, lookback).over(w)) - 1


def padded_change(c: Column | str, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """(padded value, its change over n rows) where gaps take the last value; the second reads the first as `padded`."""
    return filled(c, w), change(F.col("padded"), n, w)


def cagr(c: Column | str, w: WindowSpec, years: int, per_year: int = 12) -> Column:
    """Compound growth a year from a positive start; missing where the ratio is negative."""
    c = as_col(c)
    start = F.lag(c, per_year * years).over(w)
    ratio = F.when(start > 0, c / start)
    return F.when(ratio >= 0, F.pow(ratio, F.lit(1.0 / years)) - 1)


def annualised(r: Column | str, months: int, compound: bool = False) -> Column:
    r = as_col(r)
    f = 12.0 / months
    return F.when(1 + r >= 0, F.pow(1 + r, F.lit(f)) - 1) if compound else r * f


def _by_symbol(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(pandas frame) per symbol through Arrow: recursive averages in linear time, one exchange."""

    def each(table: pa.Table) -> pa.Table:
        out = run(table.to_pandas().sort_values("date"))
        return pa.Table.from_pandas(out, preserve_index=False)

    return df.groupBy(*keys).applyInArrow(each, schema)


class Runs:
    """Many short series end to end (each starts at position 0), stepped in lockstep: step k handles the k-th row of every
    series at once, so the cost is that of the longest series, not of their number."""

    def __init__(self, position):
        import numpy as np

        self.position = position
        starts = np.flatnonzero(position == 0)
        lengths = np.diff(np.append(starts, len(position)))
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]

    def diff(self, x):
        import numpy as np

        out = np.full(len(x), np.nan)
        out[1:] = x[1:] - x[:-1]
        out[self.starts] = np.nan
        return out

    def ewm(self, x, span: int, adjust: bool, least: int = 1):
        """Exponentially weighted mean of alpha = 2 / (span + 1). A gap keeps the last mean but ages its weight; rows
        before the `least`-th value are missing."""
        import numpy as np

        alpha = 2.0 / (span + 1)
        keep, new = 1 - alpha, 1.0 if adjust else alpha
        n = len(self.starts)
        mean, weight, seen = np.full(n, np.nan), np.ones(n), np.zeros(n, dtype=np.int64)
        out = np.empty(len(x))
        with np.errstate(invalid="ignore"):
            for k in range(self.lengths[0] if n else 0):
                a = np.searchsorted(-self.lengths, -k)  # the series longer than k come first
                at = self.starts[:a] + k
                now, m, w = x[at], mean[:a], weight[:a]
                there, started = ~np.isnan(now), ~np.isnan(m)
                both = there & started
                seen[:a] += there
                w = np.where(started, w * keep, w)
                m = np.where(both, (w * m + new * now) / (w + new), np.where(there & ~started, now, m))
                mean[:a], weight[:a] = m, np.where(both, w + new if adjust else 1.0, w)
                out[at] = np.where(seen[:a] >= least, m, np.nan)
        return out

    def rsi(self, x, period: int):
        import numpy as np

        delta = self.diff(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            up = self.ewm(np.maximum(delta, 0), period, False, period)
            down = self.ewm(np.maximum(-delta, 0), period, False, period)
            out = 100 - 100 / (1 + up / down)
        out[np.isnan(out)] = 100.0
        out[self.position < period] = np.nan
        return out

    def macd(self, x, fast: int, slow: int, signal: int):
        line = self.ewm(x, fast, False, fast) - self.ewm(x, slow, False, slow)
        smooth = self.ewm(line, signal, False, signal)
        return line, smooth, line - smooth


def _recursive(df: DataFrame, value: str, compute, names: list[str]) -> DataFrame:
    """df with columns from compute(Runs, values). A row number per symbol brings each symbol's rows together in order
    (one exchange and sort, or none if df has them already); Arrow batches are then cut where a series starts, so memory
    is bounded by the longest series, and many symbols are handled at once."""
    place = F.row_number().over(by("symbol", order="date")) - 1
    d = df.withColumn("__place", place).withColumn("__value", F.col(value).cast("double"))
    kept = len(df.columns)

    def run(batches):
        import numpy as np

        def done(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            runs = Runs(t.column(kept).to_numpy())
            made = compute(runs, t.column(kept + 1).to_numpy().astype(float))
            out = t.select(range(kept))
            for n, x in zip(names, made, strict=True):
                out = out.append_column(n, pa.array(x, mask=np.isnan(x)))
            yield from out.to_batches()

        held: list = []
        for b in batches:
            starts = np.flatnonzero(b.column(kept).to_numpy() == 0)
            cut = int(starts[-1]) if len(starts) else 0
            if len(starts) and (held or cut):
                yield from done([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield from done(held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return d.mapInArrow(run, fields + "".join(f", {n} double" for n in names))


def ema(df: DataFrame, value: str, span: int, adjust: bool, out: str = "ema", least: int = 1) -> DataFrame:
    """df(symbol, date, value) with an exponentially weighted mean of alpha = 2 / (span + 1)."""
    return _recursive(df, value, lambda runs, x: [runs.ewm(x, span, adjust, least)], [out])


def rsi(df: DataFrame, value: str = "close", period: int = 14) -> DataFrame:
    """Relative strength with alpha = 2 / (period + 1), seeded by the first change; the first `period` rows are missing
    and a series without losses (0/0 included) reads 100."""
    return _recursive(df, value, lambda runs, x: [runs.rsi(x, period)], ["rsi"])


def macd(df: DataFrame, value: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal (from the line's first value on) and histogram."""
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    return _recursive(df, value, lambda runs, x: list(runs.macd(x, fast, slow, signal)), ["macd", "signal", "histogram"])


def all_indicators(df: DataFrame, value: str = "close") -> DataFrame:
    """SMA 20/50/200, EMA 12/26, returns, volatility 20, RSI 14 and MACD of a panel (bands are a separate operator).
    Window columns come first and all recursive ones in one pass after them, which finds the rows together and in order:
    one exchange by symbol for everything."""
    w = by("symbol", order="date")
    d = df.withColumn("ret", simple_return(value, w)).withColumn("log_ret", log_return(value, w))
    d = d.select("*", *[sma(value, w, n).alias(f"sma_{n}") for n in (20, 50, 200)], rolling_volatility("ret", w, 20).alias("vol_20"))

    def compute(runs, x):
        return [runs.ewm(x, 12, True, 12), runs.ewm(x, 26, True, 26), runs.rsi(x, 14), *runs.macd(x, 12, 26, 9)]

    return _recursive(d, value, compute, ["ema_12", "ema_26", "rsi", "macd", "signal", "histogram"])


def densify(df: DataFrame, dates: DataFrame) -> DataFrame:
    """df(symbol, date, close) on the full grid of its symbols and the given dates. The dates of a panel are a calendar,
    a few thousand rows whatever the number of symbols, so they ride along as one array per symbol."""
    calendar = dates.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    symbols = df.select("symbol").distinct()
    grid = symbols.join(F.broadcast(calendar)).select("symbol", F.explode("dates").alias("date"))
    return grid.join(df, ["symbol", "date"], "left")


def kalman_beta(df: DataFrame, y: str, x: str, rounds: int = 10) -> DataFrame:
    """Time-varying regression slope per symbol: random-walk state (intercept, slope), Kalman filter, with the
    observation and state noise re-estimated by expectation-maximisation on the smoothed states.
    df(symbol, date, y, x) -> (symbol, date, alpha, beta)."""

    def run(t):
        import numpy as np

        t = t.dropna(subset=[y, x])
        n = len(t)
        if n == 0:
            t["alpha"], t["beta"] = [], []
            return t[["symbol", "date", "alpha", "beta"]]
        h = np.column_stack([np.ones(n), t[x].to_numpy(float)])
        obs = t[y].to_numpy(float)
        q, r = np.eye(2) * 1e-5, 1.0
        m0, p0 = np.zeros(2), np.eye(2)
        for _ in range(max(rounds, 1)):
            ms, ps, mp, pp = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
            m, p = m0, p0
            for i in range(n):
                if i:
                    p = p + q
                mp[i], pp[i] = m, p
                s = h[i] @ p @ h[i] + r
                k = p @ h[i] / s
                m = m + k * (obs[i] - h[i] @ m)
                p = p - np.outer(k, h[i] @ p)
                ms[i], ps[i] = m, p
            if not rounds:
                break
            sm, sp, cross = ms.copy(), ps.copy(), np.zeros((n, 2, 2))
            for i in range(n - 2, -1, -1):
                g = ps[i] @ np.linalg.pinv(pp[i + 1])
                sm[i] = ms[i] + g @ (sm[i + 1] - mp[i + 1])
                sp[i] = ps[i] + g @ (sp[i + 1] - pp[i + 1]) @ g.T
                cross[i + 1] = sp[i + 1] @ g.T
            resid = obs - (h * sm).sum(1)
            r = max(float(np.mean(resid**2 + np.einsum("ij,ijk,ik->i", h, sp, h))), 1e-12)
            if n > 1:
                d = sm[1:] - sm[:-1]
                q = (np.einsum("ij,ik->jk", d, d) + (sp[1:] + sp[:-1] - cross[1:] - cross[1:].transpose(0, 2, 1)).sum(0)) / (n - 1)
                q = (q + q.T) / 2 + np.eye(2) * 1e-12
            m0, p0 = sm[0], sp[0]
        t["alpha"], t["beta"] = ms[:, 0], ms[:, 1]
        return t[["symbol", "date", "alpha", "beta"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _by_symbol(df.select("symbol", "date", y, x), ["symbol"], run, f"symbol {kinds['symbol']}, date {kinds['date']}, alpha double, beta double")


