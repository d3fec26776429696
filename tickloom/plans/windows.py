"""Per-symbol window queries: w1 to w31."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import by, change, filled, rounded, safe_div
from ..operators import indicators as ind
from ..operators import returns as ret
from ..sources.panels import with_views
from .registry import query

def _w():
    """The panel window; made per use, since a window needs a session."""
    return by("symbol", order="date")


def _win(name: str, agg: str, n: int) -> str:
    return f"case when count({name}) over w{n} >= {n} then {agg} over w{n} end"


def _frame(*ns: int) -> str:
    return "window w as (partition by symbol order by date)" + "".join(f", w{n} as (partition by symbol order by date rows between {n - 1} preceding and current row)" for n in ns)


@query("w1_sma", with_views(f"select symbol, date, round({_win('close', 'avg(close)', 3)} + 1e-8, 6) as sma_3, round({_win('close', 'avg(close)', 12)} + 1e-8, 6) as sma_12 from px_month {_frame(3, 12)}", "px_month"))
def _(p):
    return p.px_month.select("symbol", "date", rounded(ind.sma("close", _w(), 3)).alias("sma_3"), rounded(ind.sma("close", _w(), 12)).alias("sma_12"))


@query("w2_ema", with_views("n as (select *, row_number() over (partition by symbol order by date) as i from px_month)\nselect a.symbol, a.date, round(sum(b.close * pow(1 - 2.0/13, a.i - b.i)) / sum(pow(1 - 2.0/13, a.i - b.i)) + 1e-6, 4) as ema from n a join n b on a.symbol = b.symbol and b.i <= a.i group by a.symbol, a.date", "px_month"))
def _(p):
    return ind.ema(p.px_month, "close", 12, adjust=True).select("symbol", "date", rounded("ema", 4).alias("ema"))


@query("w3_returns", with_views("select symbol, date, round(close / nullif(lag(close, 3) over w, 0) - 1 + 1e-8, 6) as ret_3, round(ln(close / nullif(lag(close, 3) over w, 0)) + 1e-8, 6) as log_3 from px_month " + _frame(), "px_month"))
def _(p):
    return p.px_month.select("symbol", "date", rounded(ind.simple_return("close", _w(), 3)).alias("ret_3"), rounded(ind.log_return("close", _w(), 3)).alias("log_3"))


@query("w4_volatility", with_views(f"select symbol, date, round({_win('r', 'stddev_samp(r)', 20)} * sqrt(252.0) + 1e-8, 6) as vol from ret_day {_frame(20)}", "ret_day"))
def _(p):
    r = p.px_day.withColumn("r", ind.simple_return("close", _w()))
    return r.select("symbol", "date", rounded(ind.rolling_volatility("r", _w(), 20)).alias("vol"))


@query("w5_bollinger", with_views(f"select symbol, date, round(m + 2 * s + 1e-6, 4) as upper, round(m + 1e-6, 4) as middle, round(m - 2 * s + 1e-6, 4) as lower from (select symbol, date, {_win('close', 'avg(close)', 12)} as m, {_win('close', 'stddev_samp(close)', 12)} as s from px_month {_frame(12)})", "px_month"))
def _(p):
    up, mid, low = ind.bollinger("close", _w(), 12)
    return p.px_month.select("symbol", "date", rounded(up, 4).alias("upper"), rounded(mid, 4).alias("middle"), rounded(low, 4).alias("lower"))


_D = """,
d as (select symbol, date, i, close - lag(close) over (partition by symbol order by i) as x
      from (select *, row_number() over (partition by symbol order by date) as i from px_month)),
"""


def _fold(source: str, column: str, span: int, first: int) -> str:
    """Sum form of the recursive mean that starts at row `first`: the first value keeps weight (1-a)^k."""
    return f"sum(case when b.i = {first} then 1 else 2.0/{span + 1} end * pow(1 - 2.0/{span + 1}, a.i - b.i) * b.{column})"


@query(
    "w6_rsi",
    with_views(
        _D
        + f"""g as (select a.symbol, a.date, a.i, {_fold('d', 'up', 14, 2)} as up, {_fold('d', 'down', 14, 2)} as down
        from d a join (select symbol, i, greatest(x, 0) as up, greatest(-x, 0) as down from d) b on a.symbol = b.symbol and b.i <= a.i and b.i >= 2 group by a.symbol, a.date, a.i)
        select p.symbol, p.date, round(case when g.i > 14 then case when down = 0 then 100.0 else 100 - 100 / (1 + up / down) end end + 1e-6, 4) as rsi
        from px_month p left join g on p.symbol = g.symbol and p.date = g.date""",
        "px_month",
    ),
)
def _(p):
    return ind.rsi(p.px_month, "close", 14).select("symbol", "date", rounded("rsi", 4).alias("rsi"))


@query(
    "w7_macd",
    with_views(
        f""", n as (select *, row_number() over (partition by symbol order by date) as i from px_month),
l as (select a.symbol, a.date, a.i, case when a.i >= 26 then {_fold('n', 'close', 12, 1)} - {_fold('n', 'close', 26, 1)} end as macd
      from n a join n b on a.symbol = b.symbol and b.i <= a.i group by a.symbol, a.date, a.i),
s as (select a.symbol, a.date, a.macd, case when a.i >= 34 then (select {_fold('l', 'macd', 9, 26)} from l b where b.symbol = a.symbol and b.i <= a.i and b.i >= 26) end as signal from l a)
select symbol, date, round(macd + 1e-6, 4) as macd, round(signal + 1e-6, 4) as signal, round(macd - signal + 1e-6, 4) as histogram from s""",
        "px_month",
    ),
)
def _(p):
    return ind.macd(p.px_month).select("symbol", "date", *[rounded(c, 4).alias(c) for c in ("macd", "signal", "histogram")])


@query("w8_all_indicators")
def _(p):
    """All indicators of the monthly panel; each is checked by its own query."""
    return ind.all_indicators(p.px_month)


_CORR = """case when count(case when r is not null and b is not null then 1 end) over f >= 20
  and var_pop(case when b is not null then r end) over f > 0 and var_pop(case when r is not null then b end) over f > 0
  then corr(case when b is not null then r end, case when r is not null then b end) over f end"""
_PAIR = ", j as (select r.symbol, r.date, r.r, b.b from ret_day r join bret_day b on r.date = b.date)\n"
_PAIR_VIEWS = ("ret_day", "bret_day")


def _pairs(p):
    b = p.bench_day.withColumn("b", change("bench", 1, by(order="date"))).select("date", "b")
    r = p.px_day.withColumn("r", ind.simple_return("close", _w())).select("symbol", "date", "r")
    return r.join(b, "date")


@query("w9_rolling_corr", (with_views(_PAIR + f"select symbol, date, round({_CORR} + 1e-6, 4) as corr_60 from j window f as (partition by symbol order by date rows between 59 preceding and current row)", *_PAIR_VIEWS)))
def _(p):
    return _pairs(p).select("symbol", "date", rounded(ind.rolling_correlation("r", "b", _w(), 60, 20), 4).alias("corr_60"))


@query("w10_rolling_beta", with_views(_PAIR + "select symbol, date, round(case when count(case when r is not null and b is not null then 1 end) over f >= 20 and count(b) over f >= 20 then covar_samp(r, b) over f / nullif(var_samp(b) over f, 0) end + 1e-6, 4) as beta_60 from j window f as (partition by symbol order by date rows between 59 preceding and current row)", *_PAIR_VIEWS))
def _(p):
    return _pairs(p).select("symbol", "date", rounded(ind.rolling_beta("r", "b", _w(), 60, 20), 4).alias("beta_60"))


@query("w11_kalman_beta")
def _(p):
    """Kalman slopes of every priority's daily return on the benchmark's."""
    return ind.kalman_beta(_pairs(p).where("r is not null and b is not null"), "r", "b", 3)


@query("w12_momentum", with_views("select symbol, date, round(lag(close, 1) over w / nullif(lag(close, 12) over w, 0) - 1 + 1e-8, 6) as momentum from px_month " + _frame(), "px_month"))
def _(p):
    return p.px_month.select("symbol", "date", rounded(ind.momentum("close", _w(), 12, 1)).alias("momentum"))


_DENSE = """,
grid as (select symbol, date from (select distinct symbol from px_month), (select distinct date from px_month)),
dense as (select symbol, date, last_value(close ignore nulls) over (partition by symbol order by date rows unbounded preceding) as padded from grid left join px_month using (symbol, date))
"""


def _dense(p):
    grid = ind.densify(p.px_month, p.px_month.select("date").distinct())
    return grid.select("symbol", "date", filled("close", _w()).alias("padded"))


@query("w13_reversal", with_views(_DENSE + "\nselect symbol, date, round(-(padded / nullif(lag(padded, 3) over w, 0) - 1) + 1e-8, 6) as reversal from dense " + _frame(), "px_month"))
def _(p):
    return _dense(p).select("symbol", "date", rounded(-change("padded", 3, _w())).alias("reversal"))


@query("w14_volatility_factor", with_views(_DENSE + f", pr as (select symbol, date, padded / nullif(lag(padded) over (partition by symbol order by date), 0) - 1 as r from dense)\nselect symbol, date, round({_win('r', 'stddev_samp(r)', 12)} * sqrt(252.0) + 1e-8, 6) as vol from pr {_frame(12)}", "px_month"))
def _(p):
    r = _dense(p).withColumn("r", change("padded", 1, _w()))
    return r.select("symbol", "date", rounded(ind.rolling_volatility("r", _w(), 12)).alias("vol"))


@query("w15_multi_horizon", with_views(_DENSE + "\nselect symbol, date, round((padded / nullif(lag(padded, 3) over w, 0) - 1) * 4 + 1e-8, 6) as past_3m, round((padded / nullif(lag(padded, 12) over w, 0) - 1) * 1 + 1e-8, 6) as past_12m, round((lead(padded, 3) over w / nullif(padded, 0) - 1) * 4 + 1e-8, 6) as forward_3m from dense " + _frame(), "px_month"))
def _(p):
    d = _dense(p)
    forward = safe_div(F.lead("padded", 3).over(_w()), "padded") - 1
    return d.select("symbol", "date", rounded(ind.annualised(change("padded", 3, _w()), 3)).alias("past_3m"), rounded(ind.annualised(change("padded", 12, _w()), 12)).alias("past_12m"), rounded(ind.annualised(forward, 3)).alias("forward_3m"))


@query("w16_forward_return", with_views("select symbol, date, round(lead(close, 1) over w + 1e-6, 4) as next_close, round(lead(close, 3) over w / nullif(close, 0) - 1 + 1e-8, 6) as forward from px_month " + _frame(), "px_month"))
def _(p):
    return p.px_month.select("symbol", "date", rounded(F.lead("close", 1).over(_w()), 4).alias("next_close"), rounded(safe_div(F.lead("close", 3).over(_w()), "close") - 1).alias("forward"))


@query("w17_annualise", with_views(", x as (select symbol, date, close / nullif(lag(close, 3) over (partition by symbol order by date), 0) - 1 as r from px_month)\nselect symbol, date, round(r * 4 + 1e-8, 6) as simple, round(pow(1 + r, 4) - 1 + 1e-8, 6) as compound from x", "px_month"))
def _(p):
    r = p.px_month.withColumn("r", ind.simple_return("close", _w(), 3))
    return r.select("symbol", "date", rounded(ind.annualised("r", 3)).alias("simple"), rounded(ind.annualised("r", 3, True)).alias("compound"))


@query("w18_cagr", with_views("select symbol, date, round(case when lag(close, 36) over w > 0 then pow(close / lag(close, 36) over w, 1.0 / 3) - 1 end + 1e-8, 6) as cagr_3y from px_month " + _frame(), "px_month"))
def _(p):
    return p.px_month.select("symbol", "date", rounded(ind.cagr("close", _w(), 3)).alias("cagr_3y"))


@query("w19_growth", with_views("select symbol, date, round(quantity / nullif(lag(quantity, 3) over w, 0) - 1 + 1e-8, 6) as qoq, round(quantity / nullif(lag(quantity, 12) over w, 0) - 1 + 1e-8, 6) as yoy, round((discount - lag(discount, 12) over w) / 1.0 + 1e-8, 6) as margin_delta, round((discount - lag(discount, 12) over w) / nullif(100 - lag(discount, 12) over w, 0) + 1e-10, 8) as margin_improvement from metrics " + _frame(), "metrics"))
def _(p):
    return p.metrics.select(
        "symbol", "date", rounded(change("quantity", 3, _w())).alias("qoq"), rounded(change("quantity", 12, _w())).alias("yoy"),
        rounded(ret.margin_delta("discount", _w(), 12)).alias("margin_delta"), rounded(ret.margin_improvement("discount", _w(), 12), 8).alias("margin_improvement"),
    )


@query("w20_lags", with_views("select symbol, date, round(lag(close, 1) over w + 1e-6, 4) as close_1m_ago, round(lag(close, 3) over w + 1e-6, 4) as close_3m_ago, round(lag(close, 12) over w + 1e-6, 4) as close_12m_ago, round(lead(close, 1) over w + 1e-6, 4) as close_1m_ahead from px_month " + _frame(), "px_month"))
def _(p):
    return p.px_month.select("symbol", "date", *[rounded(c, 4).alias(n) for n, c in ret.shifted("close", _w(), (1, 3, 12), (1,)).items()])


_MONTHS = """,
m as (select symbol, last_day(date) as month, max_by(close, date) as close from px_day group by 1, 2),
g as (select symbol, last_day(month) as month from (select symbol, unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), interval 1 month)) as month from m group by symbol)),
f as (select symbol, month, close from g left join m using (symbol, month))
"""


@query("w21_interval_returns", with_views(_MONTHS + "\nselect symbol, month, " + ", ".join(f"round(close / nullif(lag(close, {n}) over w, 0) - 1 + 1e-8, 6) as ret_{n}m" for n in (1, 3, 6, 12, 36, 60)) + " from f window w as (partition by symbol order by month)", "px_day"))
def _(p):
    return ret.interval_returns(p.px_day, (1, 3, 6, 12, 36, 60), rounded)


_PERIODS = """,
e as (select *, row_number() over (partition by symbol order by date desc) as k, max(date) over (partition by symbol) as last from px_day),
x as (select symbol, max(last) as last, max(case when k = 1 then close end) as now, max(case when k = 2 then close end) as d1, max(case when k = 6 then close end) as d5, max(case when k = 22 then close end) as d21,
      min_by(close, date) filter (where date >= date_trunc('month', last)) as mtd, min_by(close, date) filter (where date >= date_trunc('year', last)) as ytd,
      min_by(close, date) filter (where date >= last - cast(((dayofweek(last) + 6) % 7 + 6) as integer)) as tue from e group by symbol)
"""


@query("w22_period_table", with_views(_PERIODS + "\nselect symbol, " + ", ".join(f"round(now / nullif({c}, 0) - 1 + 1e-8, 6) as {n}" for n, c in (("ret_1d", "d1"), ("ret_5d", "d5"), ("ret_21d", "d21"), ("ret_mtd", "mtd"), ("ret_ytd", "ytd"), ("ret_tuesday", "tue"))) + " from x", "px_day"))
def _(p):
    return ret.period_table(p.px_day, rounded)


@query(
    "w23_previous_period_end",
    with_views(
        """,
e as (select *, max(date) over (partition by symbol) as last from px_day)
select symbol, round(max_by(close, date) / nullif(max_by(close, date) filter (where date < date_trunc('month', last)), 0) - 1 + 1e-8, 6) as mtd,
       round(max_by(close, date) / nullif(max_by(close, date) filter (where date < date_trunc('year', last)), 0) - 1 + 1e-8, 6) as ytd,
       round(ln(max_by(close, date) / nullif(max_by(close, date) filter (where date < date_trunc('year', last)), 0)) + 1e-8, 6) as ytd_log from e group by symbol""",
        "px_day",
    ),
)
def _(p):
    return ret.since_previous_end(p.px_day, rounded)


@query("w24_changes", with_views("select symbol, date, " + ", ".join(f"round(close - lag(close, {n}) over w + 1e-6, 4) as chg_{n}, round((close / nullif(lag(close, {n}) over w, 0) - 1) * 100 + 1e-5, 3) as pct_{n}" for n in (1, 5, 21)) + " from px_day " + _frame(), "px_day"))
def _(p):
    cols = [c for n in (1, 5, 21) for c in (rounded(F.col("close") - F.lag("close", n).over(_w()), 4).alias(f"chg_{n}"), rounded(change("close", n, _w()) * 100, 3).alias(f"pct_{n}"))]
    return p.px_day.select("symbol", "date", *cols)


@query("w25_cumulative", with_views("select symbol, date, round(close / nullif(first_value(close) over w, 0) - 1 + 1e-8, 6) as cumulative, round(close / nullif(first_value(close) over w, 0) * 100 + 1e-6, 4) as rebased from px_month " + _frame(), "px_month"))
def _(p):
    first = F.first("close").over(_w())
    return p.px_month.select("symbol", "date", rounded(safe_div("close", first) - 1).alias("cumulative"), rounded(safe_div("close", first) * 100, 4).alias("rebased"))


@query("w26_forward_fill", with_views(_DENSE + "\nselect symbol, date, round(padded + 1e-6, 4) as close from dense", "px_month"))
def _(p):
    return _dense(p).select("symbol", "date", rounded("padded", 4).alias("close"))


@query(
    "w27_ewm_spread",
    with_views(
        f""",
n as (select *, row_number() over (partition by symbol order by date) as i from px_month),
e as (select a.symbol, a.date, max(a.close) as close, {_fold('n', 'close', 30, 1)} as ewm from n a join n b on a.symbol = b.symbol and b.i <= a.i group by a.symbol, a.date)
select symbol, date, round(ewm + 1e-6, 4) as ewm, round(close - ewm + 1e-6, 4) as spread, round(avg(close) over (partition by symbol) + 1e-6, 4) as mean from e""",
        "px_month",
    ),
)
def _(p):
    e = ind.ema(p.px_month, "close", 30, adjust=False, out="ewm")
    return e.select("symbol", "date", rounded("ewm", 4).alias("ewm"), rounded(F.col("close") - F.col("ewm"), 4).alias("spread"), rounded(F.avg("close").over(by("symbol")), 4).alias("mean"))


@query(
    "w28_signals",
    with_views(
        _D
        + f"""g as (select a.symbol, a.date, a.i, {_fold('d', 'up', 14, 2)} as up, {_fold('d', 'down', 14, 2)} as down
        from d a join (select symbol, i, greatest(x, 0) as up, greatest(-x, 0) as down from d) b on a.symbol = b.symbol and b.i <= a.i and b.i >= 2 group by a.symbol, a.date, a.i),
        r as (select symbol, date, case when i > 14 then case when down = 0 then 100.0 else 100 - 100 / (1 + up / down) end end as rsi from g),
        s as (select symbol, date, {_win('close', 'avg(close)', 3)} as fast, {_win('close', 'avg(close)', 12)} as slow, close / nullif(lag(close, 6) over w, 0) - 1 as m, count(*) over (partition by symbol) as n from px_month {_frame(3, 12)})
        select s.symbol, s.date, case when n < 12 then null when fast > slow then 1.0 when fast < slow then -1.0 else 0.0 end::double as trend, round(m + 1e-8, 6) as momentum,
               case when n < 14 then null when rsi < 30 then 1.0 when rsi > 70 then -1.0 else 0.0 end::double as rsi_signal from s left join r on s.symbol = r.symbol and s.date = r.date""",
        "px_month",
    ),
)
def _(p):
    return ret.signals(p.px_month, 3, 12, 6).withColumn("momentum", rounded("momentum"))


@query(
    "w29_slope",
    with_views(
        """,
l as (select symbol, date, close as y0, lag(close, 1) over w as y1, lag(close, 2) over w as y2, lag(close, 3) over w as y3 from px_month window w as (partition by symbol order by date)),
u as (select symbol, date, 0 as x, y0 as y from l union all select symbol, date, -1, y1 from l union all select symbol, date, -2, y2 from l union all select symbol, date, -3, y3 from l)
select symbol, date, round(case when count(y) >= 2 then regr_slope(y, x) end + 1e-6, 4) as slope from u group by symbol, date""",
        "px_month",
    ),
)
def _(p):
    return ret.lag_slope(p.px_month, "close", 4, lambda c: rounded(c, 4))


@query("w31_log_return_table", with_views("select symbol, date, " + ", ".join(f"round(ln(close) - ln(lag(close, {m}) over w) + 1e-8, 6) as log_{m}m, round(ln(close) - ln(lead(close, {m}) over w) + 1e-8, 6) as neg_forward_{m}m" for m in (1, 3, 6, 12, 36, 60)) + " from px_month " + _frame(), "px_month"))
def _(p):
    """The forward columns are ln P(t) - ln P(t+m): the negative of the forward log return, as specified."""
    cols = []
    for m in (1, 3, 6, 12, 36, 60):
        cols += [rounded(F.ln("close") - F.ln(F.lag("close", m).over(_w()))).alias(f"log_{m}m"), rounded(F.ln("close") - F.ln(F.lead("close", m).over(_w()))).alias(f"neg_forward_{m}m")]
    return p.px_month.select("symbol", "date", *cols)


