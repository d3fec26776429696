"""Aggregate queries: a1 to a31."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import by, change, quantile_bins, rounded, safe_div
from ..operators import cleaning as cl
from ..operators import crosssection as cx
from ..operators import stats as st
from ..operators import text as tx
from ..sources.panels import with_views
from .registry import query

def _w():
    """The panel window; made per use, since a window needs a session."""
    return by("symbol", order="date")


def _returns(p):
    return p.px_day.withColumn("r", change("close", 1, _w())).select("symbol", "date", "r")


def _pairs(p):
    b = p.bench_day.select("date", change("bench", 1, by(order="date")).alias("b"))
    return _returns(p).join(b, "date")


def _round(x: str, name: str, k: int = 6) -> str:
    return f"round({x} + 1e-{k + 2}, {k}) as {name}"


_J = "j as (select r.symbol, r.date, r.r, b.b from ret_day r join bret_day b on r.date = b.date)\n"


@query("a1_moments", with_views("select symbol, " + ", ".join([_round("avg(close)", "mean", 4), _round("median(close)", "median", 4), _round("stddev_samp(close)", "std", 4), _round("stddev_pop(close)", "std0", 4), _round("var_pop(close) * count(*) / (count(*) - 2)", "var2", 2)]) + " from px_month group by symbol", "px_month"))
def _(p):
    return p.px_month.groupBy("symbol").agg(rounded(F.avg("close"), 4).alias("mean"), rounded(F.median("close"), 4).alias("median"), rounded(F.stddev_samp("close"), 4).alias("std"), rounded(F.stddev_pop("close"), 4).alias("std0"), rounded(st.variance("close", 2), 2).alias("var2"))


@query("a2_shape", with_views(f"select symbol, {_round('skewness(close)', 'skew')}, {_round('kurtosis(close)', 'kurt')} from px_month group by symbol", "px_month"))
def _(p):
    d = st.describe("close")
    return p.px_month.groupBy("symbol").agg(rounded(d["skew"]).alias("skew"), rounded(d["kurt"]).alias("kurt"))


@query("a3_quantiles", with_views(f"select symbol, {_round('quantile_cont(close, 0.1)', 'q10', 4)}, {_round('quantile_cont(close, 0.9)', 'q90', 4)}, {_round('avg(case when close < 1500 then 1 else 0 end) * 100', 'below')} from px_month group by symbol", "px_month"))
def _(p):
    q = F.percentile("close", F.array(F.lit(0.1), F.lit(0.9)))
    return p.px_month.groupBy("symbol").agg(rounded(q[0], 4).alias("q10"), rounded(q[1], 4).alias("q90"), rounded(st.percent_below("close", 1500.0)).alias("below"))


_DESCRIBE = [("count(close)", "n"), ("avg(close)", "mean"), ("median(close)", "median"), ("stddev_samp(close)", "std"), ("var_samp(close)", "var"), ("min(close)", "min"), ("max(close)", "max"), ("quantile_cont(close, 0.25)", "q25"), ("quantile_cont(close, 0.5)", "q50"), ("quantile_cont(close, 0.75)", "q75"), ("skewness(close)", "skew"), ("kurtosis(close)", "kurt")]


@query("a4_describe", with_views("select symbol, " + ", ".join(f"{e} as {n}" if n == "n" else _round(e, n, 2 if n == "var" else 4) for e, n in _DESCRIBE) + " from px_day group by symbol", "px_day"))
def _(p):
    return p.px_day.groupBy("symbol").agg(*[(c if n == "n" else rounded(c, 2 if n == "var" else 4)).alias(n) for n, c in st.describe("close").items()])


_RANKS = "k as (select *, rank() over (partition by symbol order by r) + (count(*) over (partition by symbol, r) - 1) / 2.0 as x, rank() over (partition by symbol order by b) + (count(*) over (partition by symbol, b) - 1) / 2.0 as y from j where r is not null and b is not null)"


@query("a5_correlation", with_views(_J + ", " + _RANKS + f"\nselect symbol, {_round('corr(r, b)', 'pearson')}, {_round('corr(x, y)', 'spearman')} from k group by symbol", "ret_day", "bret_day"))
def _(p):
    c = st.correlations(_pairs(p), "r", "b", ["symbol"])
    return c.select("symbol", rounded("pearson").alias("pearson"), rounded("spearman").alias("spearman"))


@query("a5_kendall", with_views(f"x as (select m.symbol, m.date, m.close, b.bench from px_month m join bench_month b on m.date = b.date)\nselect a.symbol, {_round('sum(sign(a.close - c.close) * sign(a.bench - c.bench)) / sqrt(nullif(sum(abs(sign(a.close - c.close))) * sum(abs(sign(a.bench - c.bench))), 0))', 'tau')} from x a left join x c on a.symbol = c.symbol and a.date < c.date group by a.symbol", "px_month", "bench_month"))
def _(p):
    """Of every symbol."""
    x = p.px_month.join(p.bench_month, "date")
    return st.kendall(x, "close", "bench", "date", ["symbol"]).select("symbol", rounded("tau").alias("tau"))


@query("a5_matrix", with_views(f"select x.symbol as a, y.symbol as b, {_round('corr(x.r, y.r)', 'corr')} from ret_day x join ret_day y on x.date = y.date where x.r is not null and y.r is not null group by 1, 2", "ret_day"))
def _(p):
    return st.correlation_matrix(_returns(p), "date", "symbol", "r").withColumn("corr", rounded("corr"))


@query("a6_beta", with_views(_J + f"select symbol, {_round('case when count(*) >= 2 then covar_samp(r, b) / nullif(var_samp(b), 0) end', 'beta')} from j where r is not null and b is not null group by symbol", "ret_day", "bret_day"))
def _(p):
    return _pairs(p).groupBy("symbol").agg(rounded(st.beta("r", "b")).alias("beta"))


_NEG = "stddev_samp(r) filter (where r < 0)"


@query("a7_risk_ratios", with_views(f"select symbol, {_round('stddev_samp(r) * sqrt(252)', 'volatility')}, {_round('(avg(r) - 0.02 / 252) / stddev_samp(r) * sqrt(252)', 'sharpe')}, {_round(f'(avg(r) - 0.02 / 252) / ({_NEG}) * sqrt(252)', 'sortino')}, {_round(f'({_NEG}) * sqrt(252)', 'downside')} from ret_day group by symbol", "ret_day"))
def _(p):
    return _returns(p).groupBy("symbol").agg(rounded(st.volatility("r")).alias("volatility"), rounded(st.sharpe("r", 0.02)).alias("sharpe"), rounded(st.sortino("r", 0.02)).alias("sortino"), rounded(st.downside_deviation("r")).alias("downside"))


_LEVEL = "l as (select symbol, date, r, exp(sum(ln(1 + r)) over (partition by symbol order by date)) as level from ret_day where r is not null),\nd as (select *, level / max(level) over (partition by symbol order by date) - 1 as dd from l)\n"


@query("a8_max_drawdown", with_views(_LEVEL + f"select symbol, {_round('min(dd)', 'max_drawdown', 5)} from d group by symbol", "ret_day"))
def _(p):
    return st.drawdowns(_returns(p), "r", ["symbol"]).groupBy("symbol").agg(rounded(F.min("drawdown"), 5).alias("max_drawdown"))


@query("a9_value_at_risk", with_views(f"select symbol, {_round('quantile_cont(r, 0.05)', 'historical')}, {_round('avg(r) - 1.6448536269514722 * stddev_samp(r)', 'parametric')} from ret_day group by symbol", "ret_day"))
def _(p):
    return _returns(p).groupBy("symbol").agg(rounded(st.value_at_risk("r")).alias("historical"), rounded(st.value_at_risk("r", parametric=True)).alias("parametric"))


_BETA = "covar_samp(r, b) filter (where r is not null and b is not null) / var_samp(b) filter (where r is not null and b is not null)"


@query("a10_relative_risk", with_views(_J + f"select symbol, {_round(f'(avg(r) * 252 - 0.02) / ({_BETA})', 'treynor', 4)}, {_round('avg(r - b) / stddev_samp(r - b) * sqrt(252)', 'information_ratio')} from j group by symbol", "ret_day", "bret_day"))
def _(p):
    return _pairs(p).groupBy("symbol").agg(rounded(st.treynor("r", "b", 0.02), 4).alias("treynor"), rounded(st.information_ratio("r", "b")).alias("information_ratio"))


@query("a11_risk_bundle", with_views(f"select symbol, {_round('avg(r) filter (where k <= 20)', 'momentum_exposure')}, {_round('stddev_samp(r) filter (where k <= 20)', 'volatility_exposure')}, {_round('stddev_samp(r) * sqrt(252)', 'volatility')}, {_round('avg(r) * 252 / (stddev_samp(r) * sqrt(252))', 'sharpe')} from (select *, row_number() over (partition by symbol order by date desc) as k from ret_day where r is not null) group by symbol", "ret_day"))
def _(p):
    d = _returns(p).where("r is not null").withColumn("k", F.row_number().over(by("symbol").orderBy(F.desc("date"))))
    last = F.when(F.col("k") <= 20, F.col("r"))
    vol = F.stddev_samp("r") * F.sqrt(F.lit(252.0))
    return d.groupBy("symbol").agg(rounded(F.avg(last)).alias("momentum_exposure"), rounded(F.stddev_samp(last)).alias("volatility_exposure"), rounded(vol).alias("volatility"), rounded(safe_div(F.avg("r") * 252, vol)).alias("sharpe"))


@query(
    "a12_attribution",
    with_views(
        _J
        + f""", f as (select *, lag(b) over (partition by symbol order by date) as b1 from j), g as (select * from f where r is not null and b is not null and b1 is not null),
e as (select symbol, covar_samp(r, b) / var_samp(b) as b_beta, covar_samp(r, b1) / var_samp(b1) as b1_beta, avg(r) as mr, avg(b) as mb, count(*) as n from g group by symbol)
select g.symbol, {_round('max(b_beta)', 'b_beta')}, {_round('max(b1_beta)', 'b1_beta')}, {_round('avg(r - b_beta * b)', 'residual_return')}, {_round('1 - var_samp(r - b_beta * b) / var_samp(r)', 'r_squared')} from g join e on g.symbol = e.symbol group by g.symbol""",
        "ret_day", "bret_day",
    ),
)
def _(p):
    d = _pairs(p).withColumn("b1", F.lag("b").over(_w()))
    return st.attribution(d, "r", ["b", "b1"], ["symbol"]).select("symbol", *[rounded(c).alias(c) for c in ("b_beta", "b1_beta", "residual_return", "r_squared")])


_FACTOR = "f as (select symbol, date, close / nullif(lag(close, 3) over (partition by symbol order by date), 0) - 1 as factor, lead(close, 1) over (partition by symbol order by date) / close - 1 as forward from px_month)"


def _factor(p):
    return p.px_month.select("symbol", "date", change("close", 3, _w()).alias("factor"), (safe_div(F.lead("close", 1).over(_w()), "close") - 1).alias("forward"))


_BINS = ", q as (select *, list_distinct(e) as d from (select *, quantile_cont(factor, [0, 0.2, 0.4, 0.6000000000000001, 0.8, 1]) over (partition by date) as e from f))\n, z as (select symbol, date, factor, forward, case when factor is not null and len(d) = 6 then 1 + len(list_filter(e[2:5], lambda x: x < factor - abs(factor) * 1e-12)) end as bin from q)\n"


@query("a13_quantile_returns", with_views(_FACTOR + _BINS + f"select cast(bin as integer) as bin, {_round('avg(m)', 'mean')} from (select date, bin, avg(forward) as m from z where bin is not null and forward is not null group by 1, 2) group by bin", "px_month"))
def _(p):
    d = _factor(p).withColumn("b", quantile_bins("factor", 5, "date", whole=True))
    return st.quantile_returns(d, "b", "forward").withColumn("mean", rounded("mean"))


@query("a13_long_short", with_views(_FACTOR + _BINS + f", m as (select bin, avg(m) as mean from (select date, bin, avg(forward) as m from z where bin is not null and forward is not null group by 1, 2) group by bin)\nselect {_round('max(case when bin = 5 then mean end) - max(case when bin = 1 then mean end)', 'long_short')}, {_round('(corr(bin, k) + 1) / 2', 'monotonicity')} from (select *, rank() over (order by mean) as k from m)", "px_month"))
def _(p):
    d = _factor(p).withColumn("b", quantile_bins("factor", 5, "date", whole=True))
    return st.long_short(st.quantile_returns(d, "b", "forward"), 5).select(rounded("long_short").alias("long_short"), rounded("monotonicity").alias("monotonicity"))


_IC = ", v as (select date, rank() over (partition by date order by factor) + (count(*) over (partition by date, factor) - 1) / 2.0 as x, rank() over (partition by date order by forward) + (count(*) over (partition by date, forward) - 1) / 2.0 as y from f where factor is not null and forward is not null), ic as (select date, case when count(*) >= 5 then corr(x, y) end as ic from v group by date)\n"


@query("a14_rank_ic", with_views(_FACTOR + _IC + f"select date, {_round('ic', 'ic')} from ic", "px_month"))
def _(p):
    return st.ic_series(_factor(p), "factor", "forward").withColumn("ic", rounded("ic"))


@query("a14_ic_summary", with_views(_FACTOR + _IC + f"select {_round('avg(ic)', 'mean_ic')}, {_round('stddev_samp(ic)', 'std_ic')}, {_round('avg(ic) / stddev_samp(ic)', 'ir')}, {_round('avg(ic) / stddev_samp(ic) * sqrt(count(ic))', 't_stat')}, count(ic) as n, {_round('avg(case when ic > 0 then 1.0 when ic is not null then 0 end)', 'positive')} from ic", "px_month"))
def _(p):
    s = st.ic_summary(st.ic_series(_factor(p), "factor", "forward"))
    return s.select(*[rounded(c).alias(c) for c in ("mean_ic", "std_ic", "ir", "t_stat")], "n", rounded("positive").alias("positive"))


@query("a15_winsorised_mean", with_views(f"e as (select date, quantile_cont(close, 0.1) as lo, quantile_cont(close, 0.9) as hi from px_month group by date)\nselect date, {_round('avg(greatest(lo, least(hi, close)))', 'mean', 4)}, {_round('stddev_samp(greatest(lo, least(hi, close)))', 'std', 4)} from px_month join e using (date) group by date", "px_month"))
def _(p):
    m = st.winsorised_mean(p.px_month.select("date", "close"), "close", ["date"], 0.1, 0.9, deviation=True)
    return m.select("date", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"))


@query("a16_coverage", with_views("d as (select date, symbol, close from (select symbol, date from (select distinct symbol from px_month), (select distinct date from px_month)) left join px_month using (symbol, date))\nselect date, count(*) as n, count(close) as present, count(*) - count(close) as absent, " + _round("count(close)::double / count(*)", "coverage") + " from d group by date", "px_month"))
def _(p):
    from ..operators.indicators import densify

    grid = densify(p.px_month, p.px_month.select("date").distinct())
    return st.coverage(grid, "close", ["date"]).withColumn("coverage", rounded("coverage"))


@query("a17_mean_by_label", with_views(_FACTOR + _BINS + f"select cast(year(date) as integer) as year, cast(bin as integer) as bin, {_round('avg(forward)', 'mean')}, count(forward) as n from z where bin is not null group by 1, 2", "px_month"))
def _(p):
    d = _factor(p).withColumn("bin", quantile_bins("factor", 5, "date", whole=True)).where("bin is not null")
    return d.groupBy(F.year("date").alias("year"), "bin").agg(rounded(F.avg("forward")).alias("mean"), F.count("forward").alias("n"))


@query("a18_transitions", with_views(_FACTOR + _BINS + "select cast(bin as integer) as now, cast(nxt as integer) as next, count(*) as n from (select bin, lead(bin) over (partition by symbol order by date) as nxt from z) where bin is not null and nxt is not null group by 1, 2", "px_month"))
def _(p):
    d = _factor(p).withColumn("now", quantile_bins("factor", 5, "date", whole=True))
    return cx.transitions(d.withColumn("next", F.lead("now").over(_w())), "now", "next")


@query("a19_best_worst", with_views(f"select date, arg_min(symbol, (-r, symbol)) as best, arg_min(symbol, (r, symbol)) as worst, {_round('avg(r)', 'average')} from ret_day where r is not null group by date", "ret_day"))
def _(p):
    return st.best_worst(_returns(p), "symbol", "r", ["date"]).withColumn("average", rounded("average"))


@query("a20_freshness", with_views("l as (select symbol, max(date) as date from px_day group by symbol)\nselect symbol, date, date = (select max(date) from l) as is_newest, date = (select min(date) from l) as is_oldest, cast(date_diff('day', date, (select max(date) from l)) as integer) as gap_days from l", "px_day"))
def _(p):
    return st.freshness(p.px_day)


@query("a21_busiest_date", "select d as date, n from (select d, count(*) as n from (select cast(o_orderdate as date) as d from orders union all select cast(l_shipdate as date) from lineitem) group by d) order by n desc, d limit 1")
def _(p):
    both = p.table("orders").select(F.col("o_orderdate").cast("date").alias("date")).unionByName(p.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date")))
    return both.groupBy("date").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "date").limit(1)


@query("a22_allocation", with_views(f"select coalesce(sector, 'Other') as sector, {_round('sum(s_acctbal)', 'total', 2)} from supplier left join (select * from sectors where sector <> 'EUROPE') x on s_suppkey = symbol group by 1", "sectors"))
def _(p):
    s = p.table("supplier").join(p.sectors.where("sector <> 'EUROPE'"), F.col("s_suppkey") == F.col("symbol"), "left")
    return s.groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(rounded(F.sum("s_acctbal"), 2).alias("total"))


_CLAIMS = "c as (select p_brand as ticker, p_size / 50.0 as confidence, p_partkey % 3 = 0 as growth, p_partkey % 4 = 0 as r6, p_partkey % 5 = 0 as r11 from part), w as (select *, case when r11 then 2.0 when r6 then 1.5 else 1.0 end as w, case when growth then confidence * case when confidence >= 0.7 then 1.1 else 0.9 end else confidence end as x from c)\n"


@query("a23_claim_scores", "with " + _CLAIMS + f"select ticker, {_round('greatest(0, least(1, sum(w * x) / sum(w)))', 'score')}, count(*) as claims, {_round('sum(case when r6 or r11 then w else 0 end) / sum(w)', 'structural')} from w group by ticker")
def _(p):
    k = F.col("p_partkey")
    rules = F.filter(F.array(F.when(k % 4 == 0, "rule_6"), F.when(k % 5 == 0, "rule_11")), lambda x: x.isNotNull())
    claims = p.table("part").select(F.col("p_brand").alias("ticker"), (F.col("p_size") / 50.0).alias("confidence"), F.when(k % 3 == 0, "cagr_connection").otherwise("other").alias("claim_type"), rules.alias("rules"))
    return st.claim_scores(claims).select("ticker", rounded("score").alias("score"), "claims", rounded("structural").alias("structural"))


@query("a24_success_by_host", r"""with h as (select regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') as host, length(html) > 2000 as ok from pages)
select host, count(*) as n, count(*) filter (where ok) as succeeded, round(count(*) filter (where ok) / count(*)::double + 1e-8, 6) as rate from h group by host""")
def _(p):
    d = p.table("pages").select(F.regexp_replace(cl.host("url"), r"^www\.", "").alias("host"), (F.length("html") > 2000).alias("ok"))
    n, ok = F.count("*"), F.count_if(F.col("ok"))
    return d.groupBy("host").agg(n.alias("n"), ok.alias("succeeded"), rounded(ok / n).alias("rate"))


@query("a25_group_articles", "select coalesce(map_extract_value(MAP {'en': 'world', 'fr': 'europe', 'de': 'europe'}, lang), 'other') as category, date '2024-01-01' + cast(doc_id % 30 as integer) as day, count(*) as n, min(doc_id) as first from documents group by 1, 2")
def _(p):
    d = p.table("documents").select("doc_id", "lang", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"))
    return tx.group_by_category(d, "lang", {"en": "world", "fr": "europe", "de": "europe"}, "other").select("category", "day", "n", "first")


@query("a26_moat_score", "select ticker, cast(overall as integer) as overall, case when overall >= 70 then 'wide' when overall >= 40 then 'narrow' else 'none' end as strength, dominant from (select p_brand as ticker, sum(c) // count(*) as overall, arg_min(moat, (-a, moat)) filter (where moat <> 'none' and a > 0) as dominant from (select *, sum(c) over (partition by p_brand, moat) // count(*) over (partition by p_brand, moat) as a from (select p_brand, case p_partkey % 4 when 0 then 'brand' when 1 then 'cost' when 2 then 'network' else 'none' end as moat, cast((p_size % 5) * 20 + 10 as integer) as c from part)) group by p_brand)")
def _(p):
    k = F.col("p_partkey") % 4
    claims = p.table("part").select(F.col("p_brand").alias("ticker"), F.when(k == 0, "brand").when(k == 1, "cost").when(k == 2, "network").otherwise("none").alias("moat"), ((F.col("p_size") % 5) * 20 + 10).alias("confidence"))
    return tx.moat_score(claims)


@query("a27_batch_statistics", "select count(distinct source) as feeds, count(*) as items, count(*) filter (where doc_id >= 500) as new_items, count(distinct source) filter (where n_chars > 10000) as large_feeds from documents")
def _(p):
    return p.table("documents").agg(F.count_distinct("source").alias("feeds"), F.count("*").alias("items"), F.count_if(F.col("doc_id") >= 500).alias("new_items"), F.count_distinct(F.when(F.col("n_chars") > 10000, F.col("source"))).alias("large_feeds"))


@query("a28_cost_by_phase", "select event_type as phase, count(*) as calls, round(sum(value) + 1e-6, 4) as cost, round(avg(value) + 1e-6, 4) as mean from events group by event_type")
def _(p):
    return p.table("events").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), rounded(F.sum("value"), 4).alias("cost"), rounded(F.avg("value"), 4).alias("mean"))


@query("a29_price_summary", with_views(f"g as (select symbol, min(close) as low, max(close) as high, avg(close) as mean, stddev_samp(close) as std, max_by(close, date) - min_by(close, date) as change, (max_by(close, date) - min_by(close, date)) / min_by(close, date) * 100 as pct, count(close) > 20 and coalesce(stddev_samp(r), 0) * 100 > 3 as volatile from ret_month group by symbol)\nselect symbol, {', '.join(_round(c, c, 4) for c in ('low', 'high', 'mean', 'std', 'change', 'pct'))}, case when pct > 10 then 'up' when pct < -10 then 'down' else 'stable' end as trend, volatile from g", "ret_month"))
def _(p):
    s = st.price_summary(p.px_month, ["symbol"])
    return s.select("symbol", *[rounded(c, 4).alias(c) for c in ("low", "high", "mean", "std", "change", "pct")], "trend", "volatile")


_LAST = "x as (select symbol, avg(discount) as a, sum(quantity) as b from metrics group by symbol)"


@query("a30_hit_rate", with_views(_LAST + ", n as (select greatest(1, cast(round_even(count(*) * 0.2, 0) as bigint)) as n from x), t as (select symbol, row_number() over (order by a desc, symbol) as ka, row_number() over (order by b desc, symbol) as kb from x)\nselect count(*) as n, count(*) filter (where kb <= (select n from n)) as hits, round(count(*) filter (where kb <= (select n from n)) / count(*)::double + 1e-8, 6) as rate from t where ka <= (select n from n)", "metrics"))
def _(p):
    d = p.metrics.groupBy("symbol").agg(F.avg("discount").alias("a"), F.sum("quantity").alias("b"))
    return st.hit_rate(d, "a", "b", "symbol").withColumn("rate", rounded("rate"))


@query("a31_analyst_correlation", with_views(_LAST + f", k as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as y from x)\nselect {_round('corr(x, y)', 'spearman')} from k", "metrics"))
def _(p):
    """Spearman of two scores over all symbols."""
    d = p.metrics.groupBy("symbol").agg(F.avg("discount").alias("a"), F.sum("quantity").alias("b"))
    return st.spearman(d, "a", "b").select(rounded("spearman").alias("spearman"))


