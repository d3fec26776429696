"""Cross-section, portfolio and regression queries: x, b and l."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import by, change, finite, percent_rank_average, quantile_bins, rounded
from ..operators import crosssection as cx
from ..operators import indicators as ind
from ..operators import linear as ln
from ..operators import portfolio as pf
from ..operators import text as tx
from ..sources.panels import with_views
from .aggregates import _pairs, _round
from .registry import query

def _w():
    """The panel window; made per use, since a window needs a session."""
    return by("symbol", order="date")

_F = "f as (select symbol, date, close / nullif(lag(close, 3) over (partition by symbol order by date), 0) - 1 as x from px_month)"


def _f(p):
    return p.px_month.select("symbol", "date", change("close", 3, _w()).alias("x"))


def _fs(p):
    return _f(p).join(p.sectors, "symbol")


def _robust(c: str, keys: str, source: str, least: int = 5, name: str = "z") -> str:
    """Robust z of c by keys over `source`, as the body of a table expression."""
    return f"select *, case when count({c}) over (partition by {keys}) >= {least} then ({c} - m) / nullif(1.4826 * median(abs({c} - m)) over (partition by {keys}), 0) end as {name} from (select *, median({c}) over (partition by {keys}) as m from {source})"


@query("x1_zscore", with_views(_F + f", r as ({_robust('x', 'date', 'f')})\nselect symbol, date, {_round('z', 'robust', 5)}, {_round('case when count(x) over (partition by date) >= 5 then (x - avg(x) over (partition by date)) / nullif(stddev_samp(x) over (partition by date), 0) end', 'standard')} from r", "px_month"))
def _(p):
    d = cx.zscore(cx.zscore(_f(p), "x", ["date"], "robust"), "x", ["date"], "standard", robust=False)
    return d.select("symbol", "date", rounded("robust", 5).alias("robust"), rounded("standard").alias("standard"))


_PR = "case when {c} is not null then (rank() over (partition by {k} order by {c}) + (count(*) over (partition by {k}, {c}) - 1) / 2.0) / count({c}) over (partition by {k}) end"


@query("x2_percent_rank", with_views(_F + f"\nselect symbol, date, {_round(_PR.format(c='x', k='date'), 'pct_rank')} from f", "px_month"))
def _(p):
    return _f(p).select("symbol", "date", rounded(percent_rank_average("x", "date")).alias("pct_rank"))


def _bins(c: str, keys: str, source: str, whole: bool = False) -> str:
    """A table expression: source with bin."""
    test = "len(list_distinct(e)) = 6" if whole else "len(list_distinct(e)) >= 2"
    edges = f"quantile_cont({c}, [0, 0.2, 0.4, 0.6000000000000001, 0.8, 1]) over (partition by {keys})"
    return f"select * exclude (e), case when {c} is not null and {test} then cast(1 + len(list_filter(list_sort(list_distinct(e))[2:len(list_distinct(e)) - 1], lambda q: q < {c} - abs({c}) * 1e-12)) as integer) end as bin from (select *, {edges} as e from {source})"


_TIED = "t as (select l_suppkey as symbol, last_day(cast(l_shipdate as date)) as date, cast(max(l_quantity) as double) as x from lineitem group by 1, 2)"


@query("x3_quintile", with_views(_TIED + f", q as ({_bins('x', 'date', 't')})\nselect symbol, date, bin, case when bin is not null then 'Q' || bin end as label from q", "px_month"))
def _(p):
    t = p.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.last_day(F.col("l_shipdate").cast("date")).alias("date")).agg(F.max("l_quantity").alias("x"))
    d = t.withColumn("bin", quantile_bins("x", 5, "date"))
    return d.select("symbol", "date", "bin", F.when(F.col("bin").isNotNull(), F.concat(F.lit("Q"), F.col("bin").cast("string"))).alias("label"))


@query("x4_winsorise", with_views(_F + ", q as (select *, quantile_cont(x, 0.05) over (partition by date) as lo, quantile_cont(x, 0.95) over (partition by date) as hi from f)\nselect symbol, date, case when x is not null then round(greatest(lo, least(hi, x)) + 1e-8, 6) end as x from q", "px_month"))
def _(p):
    return _f(p).select("symbol", "date", rounded(cx.winsorise("x", 0.05, 0.05, "date")).alias("x"))


@query("x5_by_group", with_views(_F + f", g as (select f.*, sector from f join sectors using (symbol)), r as ({_robust('x', 'date, sector', 'g', 3)})\nselect symbol, date, sector, {_round('z', 'z', 5)}, {_round(_PR.format(c='x', k='date, sector'), 'pct_rank')} from r", "px_month", "sectors"))
def _(p):
    d = cx.zscore(_fs(p), "x", ["date", "sector"], "z", least=3)
    return d.select("symbol", "date", "sector", rounded("z", 5).alias("z"), rounded(percent_rank_average("x", "date", "sector")).alias("pct_rank"))


_X6 = ", w as (select *, case when count(x) over (partition by {k}) >= 10 then case when x is not null then greatest(quantile_cont(x, 0.01) over (partition by {k}), least(quantile_cont(x, 0.99) over (partition by {k}), x)) end else x end as v from {s})"


@query("x6_factor_metrics", with_views(_F + _X6.format(k="date", s="f") + f", q as ({_bins('v', 'date', 'w')})\nselect symbol, date, {_round('1 - ' + _PR.format(c='v', k='date'), 'pct_rank')}, 6 - bin as quintile, {_round('-((v - avg(v) over (partition by date)) / nullif(stddev_samp(v) over (partition by date), 0))', 'z')} from q", "px_month"))
def _(p):
    d = cx.factor_metrics(_f(p), "x", ["date"], inverted=True)
    return d.select("symbol", "date", rounded("pct_rank").alias("pct_rank"), "quintile", rounded("z").alias("z"))


@query("x7_rank_labels", with_views(_F + f", q as ({_bins('x', 'date', 'f')})\nselect symbol, date, case when bin is not null then 'rank' || (6 - bin) end as label from q", "px_month"))
def _(p):
    return _f(p).select("symbol", "date", cx.rank_labels(quantile_bins("x", 5, "date")).alias("label"))


@query(
    "x8_transition_label",
    with_views(
        _F
        + f""", q as ({_bins('x', 'date', 'f')}), l as (select symbol, date, 6 - bin as a, lead(6 - bin, 1) over w as b, lead(6 - bin, 2) over w as c from q window w as (partition by symbol order by date))
select symbol, date, case when a is null or b is null or c is null then null when a <= 2 and b <= 2 and c <= 2 then 'remain high' when a >= 4 and b >= 4 and c >= 4 then 'remain low'
when a > 2 and c <= 2 then 'move to high' when a < 4 and c >= 4 then 'drop to low' else 'others' end as label from l""",
        "px_month",
    ),
)
def _(p):
    d = _f(p).withColumn("k", cx.rank_labels(quantile_bins("x", 5, "date")))
    d = d.select("symbol", "date", "k", F.lead("k", 1).over(_w()).alias("k1"), F.lead("k", 2).over(_w()).alias("k2"))
    return d.select("symbol", "date", cx.transition_label([F.col("k"), F.col("k1"), F.col("k2")], ["rank1", "rank2"], ["rank4", "rank5"]).alias("label"))


@query("x9_quantiles_per_date", with_views(_F + f", q as ({_bins('x', 'date', 'f', True)})\nselect symbol, date, bin from q", "px_month"))
def _(p):
    return cx.binned(_f(p), "x", 5, ["date"], whole=True).select("symbol", "date", "bin")


@query("x10_sector_scores", with_views(_F + f", g as (select f.*, sector from f join sectors using (symbol)), r as ({_robust('x', 'date, sector', 'g', 2)})\nselect symbol, date, {_round('z', 'z', 5)}, cast(rank() over (partition by date, sector order by x desc nulls last) as integer) as sector_rank from r", "px_month", "sectors"))
def _(p):
    return cx.sector_scores(_fs(p), "x").select("symbol", "date", rounded("z", 5).alias("z"), "sector_rank")


_SR = "s as (select sector, avg(x) as v from f join sectors using (symbol) group by sector)"


@query("x11_top_bottom", with_views(_F + f", {_SR}\nselect 'top' as side, cast(row_number() over (order by v desc, sector) as integer) as place, sector as name, {_round('v', 'value')} from s qualify place <= 3 union all select 'bottom', cast(row_number() over (order by v, sector desc) as integer) as place, sector, {_round('v', 'value')} from s qualify place <= 3", "px_month", "sectors"))
def _(p):
    s = _fs(p).groupBy("sector").agg(F.avg("x").alias("v"))
    return cx.extremes(s, "sector", "v", 3).withColumn("value", rounded("value"))


@query("x12_composite", with_views(f"a as ({_robust('discount', 'date', 'metrics', 1, 'z1')}), b as ({_robust('tax', 'date', '(select * exclude (m) from a)', 1, 'z2')}), c as ({_robust('quantity', 'date', '(select * exclude (m) from b)', 1, 'z3')})\nselect symbol, date, {_round('-0.5 * z1 + 0.3 * z2 + 0.2 * z3', 'score', 5)} from c", "metrics"))
def _(p):
    d = cx.composite(p.metrics, {"discount": (0.5, True), "tax": (0.3, False), "quantity": (0.2, False)}, ["date"])
    return d.select("symbol", "date", rounded("score", 5).alias("score"))


@query("x13_single_metric", with_views(f"select symbol, date, {_round('-discount', 'value')}, {_round('tax', 'quality')}, {_round('ln(1 + price)', 'size')} from metrics", "metrics"))
def _(p):
    return p.metrics.select("symbol", "date", rounded(-F.col("discount")).alias("value"), rounded("tax").alias("quality"), rounded(F.log1p("price")).alias("size"))


@query("x14_active_return", with_views(f"select r.symbol, r.date, {_round('r.r - b.b', 'active')} from ret_month r left join bret_month b on r.date = b.date", "ret_month", "bret_month"))
def _(p):
    r = p.px_month.select("symbol", "date", change("close", 1, _w()).alias("r"))
    b = p.bench_month.select("date", change("bench", 1, by(order="date")).alias("b"))
    return cx.active_return(r, b, ["date"]).select("symbol", "date", rounded("active").alias("active"))


@query("x15_median_fill", with_views("g as (select symbol, date, sector, case when symbol % 3 <> 0 then discount end as x from metrics join sectors using (symbol))\nselect symbol, date, " + _round("coalesce(x, median(x) over (partition by date, sector), median(x) over (partition by date), 0.5)", "x") + " from g", "metrics", "sectors"))
def _(p):
    g = p.metrics.join(p.sectors, "symbol").withColumn("x", F.when(F.col("symbol") % 3 != 0, F.col("discount")))
    return g.select("symbol", "date", rounded(cx.filled_by_median("x")).alias("x"))


@query("x16_blended_score", with_views(f"k as (select symbol, date, {_PR.format(c='discount', k='date')} as a, {_PR.format(c='tax', k='date')} as b from metrics), s as (select symbol, date, round(0.6 * a + 0.4 * b + 1e-8, 6) as score from k), q as ({_bins('score', 'date', 's', True)})\nselect symbol, date, score, case when bin is not null then 'rank' || (6 - bin) end as label from q", "metrics"))
def _(p):
    a, b = percent_rank_average("discount", "date"), percent_rank_average("tax", "date")
    d = p.metrics.select("symbol", "date", rounded(0.6 * a + 0.4 * b).alias("score"))
    return cx.binned(d, "score", 5, ["date"], whole=True).select("symbol", "date", "score", cx.rank_labels(F.col("bin")).alias("label"))


@query("x17_acceleration", with_views("g as (select symbol, date, quantity / nullif(lag(quantity, 12) over w, 0) - 1 as yoy, case when lag(quantity, 36) over w > 0 then pow(quantity / lag(quantity, 36) over w, 1.0 / 3) - 1 end as cagr from metrics window w as (partition by symbol order by date)), e as (select quantile_cont(abs(cagr), 0.05) as floor from g)\nselect symbol, date, " + _round("case when yoy is not null and cagr is not null then greatest(-5.0, least(5.0, (yoy - cagr) / greatest(abs(cagr), floor))) end", "relative", 4) + ", " + _round("yoy - cagr", "absolute") + " from g, e", "metrics"))
def _(p):
    w = _w()
    g = p.metrics.select("symbol", "date", finite(change("quantity", 12, w)).alias("yoy"), ind.cagr("quantity", w, 3).alias("cagr"))
    g = g.join(F.broadcast(cx.smallest_scale(g, "cagr")))
    rel, gap = cx.acceleration(F.col("yoy"), F.col("cagr"), F.col("floor"), 5.0)
    return g.select("symbol", "date", rounded(rel, 4).alias("relative"), rounded(gap).alias("absolute"))


@query("x18_rank_batch", with_views(_X6.format(k="date, variable", s="(select symbol, date, variable, value as x from facts)").lstrip(", ") + f", q as ({_bins('v', 'date, variable', 'w')})\nselect symbol, date, variable, {_round(_PR.format(c='v', k='date, variable'), 'pct_rank')}, bin as quintile, {_round('(v - avg(v) over (partition by date, variable)) / nullif(stddev_samp(v) over (partition by date, variable), 0)', 'z')} from q", "facts"))
def _(p):
    d = cx.rank_batch(p.facts)
    return d.select("symbol", "date", "variable", rounded("pct_rank").alias("pct_rank"), "quintile", rounded("z").alias("z"))


@query("x19_newest_page", "select doc_id, ts from (select doc_id, case when doc_id % 7 = 0 then null else date '2024-01-01' + cast(doc_id % 50 as integer) end as ts from documents) order by ts desc nulls last, doc_id limit 20 offset 5")
def _(p):
    d = p.table("documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 50).cast("int"))).alias("ts"))
    return tx.newest(d, "ts", "doc_id", 20, 5)


@query("x20_top_per_theme", "select * from (select source, doc_id, cast(row_number() over (partition by source order by n_chars desc, doc_id) as integer) as place from documents) where place <= 5")
def _(p):
    return tx.top_per(p.table("documents"), ["source"], 5, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "place")


@query("x21_best_record", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by case when role = 'assistant' then 1 else 0 end desc, turn) as k from conversations) where k = 1")
def _(p):
    audited = (F.col("role") == "assistant").cast("int")
    return tx.top_per(p.table("conversations"), ["conv_id"], 1, audited.desc(), F.col("turn")).select("conv_id", "turn", "role")


@query("x22_latest_runs", "select event_id, event_type from events order by ts desc, event_id desc limit 10")
def _(p):
    return p.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


@query("x23_double_sort", with_views(f"q as ({_bins('discount', 'date', 'metrics')}), r as (select symbol, date, discount, tax, bin as bin_a from q), t as ({_bins('tax', 'date, bin_a', 'r')})\nselect symbol, date, bin_a, bin as bin_b from t", "metrics"))
def _(p):
    return cx.double_sort(p.metrics, "discount", "tax", 5, conditional=True).select("symbol", "date", "bin_a", "bin_b")


@query("x23_persistence", with_views(f"q as ({_bins('discount', 'date', 'metrics')}), r as (select symbol, bin, lead(bin) over (partition by symbol order by date) as nxt from q)\nselect bin, count(*) as n, {_round('avg(case when bin = nxt then 1.0 else 0 end)', 'kept')} from r where bin is not null and nxt is not null group by bin", "metrics"))
def _(p):
    return cx.rank_persistence(p.metrics, "discount").withColumn("kept", rounded("kept"))


_STOCKS = "k as (select symbol, sector, round(avg(discount) * 10 + 1e-8, 6) as score from metrics join sectors using (symbol) group by 1, 2), b as (select sector, count(*) / sum(count(*)) over () as weight from sectors group by sector)"
_COUNTS = ", c as (select b.sector, weight, n as available, 20 * weight as raw from b join (select sector, count(*) as n from k group by sector) using (sector)), d as (select *, raw - floor(raw) as rest, round(sum(raw) over ()) - sum(floor(raw)) over () as short from c), e as (select sector, weight, available, cast(greatest(1, least(floor(raw) + case when row_number() over (order by rest desc, sector) <= short then 1 else 0 end, available)) as integer) as n from d)"
_BUILD = ", p as (select *, row_number() over (partition by sector order by score desc, symbol) as place from k join e using (sector)), g as (select *, score / sum(score) over (partition by sector) * weight as raw from p where place <= n), h as (select symbol, sector, score, raw / sum(raw) over () as w from g)"


def _stocks(p):
    s = p.metrics.join(p.sectors, "symbol").groupBy("symbol", "sector").agg(rounded(F.avg("discount") * 10).alias("score"))
    n = p.sectors.agg(F.count("*").alias("whole"))
    b = p.sectors.groupBy("sector").agg(F.count("*").alias("k")).join(F.broadcast(n)).select("sector", (F.col("k") / F.col("whole")).alias("weight"))
    return s, b


@query("b1_largest_remainder", with_views(_STOCKS + _COUNTS + "\nselect sector, n from e", "metrics", "sectors"))
def _(p):
    return pf.sector_counts(*_stocks(p), 20).select("sector", "n")


@query("b2_score_weights", with_views(_STOCKS + _COUNTS + _BUILD + f"\nselect symbol, sector, {_round('w', 'weight')} from h", "metrics", "sectors"))
def _(p):
    return pf.build(*_stocks(p), 20).select("symbol", "sector", rounded("weight").alias("weight"))


@query("b3_sector_allocation", with_views(_STOCKS + _COUNTS + _BUILD + f"\nselect h.sector, {_round('max(weight)', 'benchmark')}, {_round('sum(w)', 'actual')}, count(*) as n from h join b using (sector) group by h.sector", "metrics", "sectors"))
def _(p):
    s, b = _stocks(p)
    a = pf.allocations(pf.build(s, b, 20), b)
    return a.select("sector", rounded("benchmark").alias("benchmark"), rounded("actual").alias("actual"), "n")


@query("b4_equal_weight", with_views(_STOCKS + f"\nselect symbol, sector, {_round('1.0 / count(*) over ()', 'weight')} from k where score > 0.5", "metrics", "sectors"))
def _(p):
    return pf.equal_weight(_stocks(p)[0], 0.5).select("symbol", "sector", rounded("weight").alias("weight"))


_EVAL = "j as (select r.symbol, r.date, r.r, b.b from ret_day r join bret_day b on r.date = b.date where r.r is not null and b.b is not null)"


@query("b5_evaluation", with_views(_EVAL + f", l as (select *, exp(sum(ln(1 + r)) over (partition by symbol order by date)) as level from j), d as (select *, level / max(level) over (partition by symbol order by date) - 1 as dd from l)\nselect symbol, {_round('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')}, {_round('min(dd)', 'max_drawdown', 5)}, {_round('covar_samp(r, b) / var_samp(b)', 'beta')}, {_round('avg(r - b) / stddev_samp(r - b) * sqrt(252)', 'information_ratio')}, {_round('max_by(level, date) - 1', 'cumulative', 5)} from d group by symbol", "ret_day", "bret_day"))
def _(p):
    from ..operators import stats as st

    d = st.drawdowns(_pairs(p).where("r is not null and b is not null"), "r", ["symbol"])
    return d.groupBy("symbol").agg(rounded(st.sharpe("r")).alias("sharpe"), rounded(F.min("drawdown"), 5).alias("max_drawdown"), rounded(st.beta("r", "b")).alias("beta"), rounded(st.information_ratio("r", "b")).alias("information_ratio"), rounded(F.max_by("level", "date") - 1, 5).alias("cumulative"))


@query("b6_integrated", with_views(f"select r.symbol, {_round('avg(r) * 252', 'annual_return')}, {_round('stddev_samp(r) * sqrt(252)', 'annual_volatility')}, {_round('max_by(s3, date)', 'last_sma', 4)}, count(r) as n from (select *, case when count(close) over w3 >= 3 then avg(close) over w3 end as s3 from ret_day window w3 as (partition by symbol order by date rows between 2 preceding and current row)) r group by r.symbol", "ret_day"))
def _(p):
    d = p.px_day.select("symbol", "date", change("close", 1, _w()).alias("r"), ind.sma("close", _w(), 3).alias("s3"))
    return d.groupBy("symbol").agg(rounded(F.avg("r") * 252).alias("annual_return"), rounded(F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("annual_volatility"), rounded(F.max_by("s3", "date"), 4).alias("last_sma"), F.count("r").alias("n"))


@query("b7_universe", with_views(f"select sector, {_round('sum(s_acctbal) / (select sum(s_acctbal) from supplier)', 'weight')}, count(*) as n from supplier join sectors on s_suppkey = symbol group by sector", "sectors"))
def _(p):
    h = p.table("supplier").join(p.sectors, F.col("s_suppkey") == F.col("symbol")).select("sector", F.col("s_acctbal").alias("value"))
    return pf.universe(h).withColumn("weight", rounded("weight"))


@query("l1_orthogonalise", with_views("j as (select r.symbol, r.date, r.r, b.b from ret_day r join bret_day b on r.date = b.date), k as (select symbol, regr_slope(r, b) as s, regr_intercept(r, b) as i from j where r is not null and b is not null group by symbol)\nselect j.symbol, date, " + _round("r - i - s * b", "residual") + " from j join k using (symbol)", "ret_day", "bret_day"))
def _(p):
    return ln.residual(_pairs(p), "r", "b", ["symbol"]).select("symbol", "date", rounded("residual").alias("residual"))


_TENORS = ["p1", "p2", "p3", "p4", "p5"]


def _curve(p):
    wide = p.px_day.groupBy("date").pivot("symbol", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.first("close"))
    return wide.toDF("date", *_TENORS)


@query("l2_cascade")
def _(p):
    """Monthly metrics of every supplier, each cleaned of those before it."""
    return ln.cascade(p.metrics, ["discount", "tax", "quantity"], ["symbol"], "symbol long")


@query("l3_principal_components")
def _(p):
    """Scores of the daily price changes by priority on their first three components."""
    moved = ln.differences(_curve(p), _TENORS)
    return moved.select("date", *ln.Components(moved, _TENORS, 3).transform(["level", "slope", "curvature"]))


@query("l4_macro_shocks", with_views("a as (select date, max(case when symbol = '1-URGENT' then close end) - max(case when symbol = '5-LOW' then close end) as spread, max(case when symbol = '3-MEDIUM' then close end) as be from px_day group by date), b as (select * from a where spread is not null and be is not null)\nselect date, " + _round("spread - lag(spread) over (order by date)", "credit", 4) + ", " + _round("be - lag(be) over (order by date)", "inflation", 4) + " from b", "px_day"))
def _(p):
    d = _curve(p).select("date", (F.col("p1") - F.col("p5")).alias("spread"), F.col("p3").alias("be")).dropna()
    w = by(order="date")
    return d.select("date", rounded(F.col("spread") - F.lag("spread").over(w), 4).alias("credit"), rounded(F.col("be") - F.lag("be").over(w), 4).alias("inflation"))


@query("l5_macro_factors")
def _(p):
    """The six factors, cleaned in order, on daily prices as yields."""
    c = _curve(p)
    series = c.join(p.bench_day, "date").select("date", F.col("bench").alias("market"), F.lit(1.0).alias("risk_free"), F.col("p5").alias("credit_high"), F.col("p1").alias("credit_low"), F.col("p3").alias("breakeven"))
    return ln.macro_factors(c, _TENORS, series)


@query("l6_curve_state", with_views("a as (select date, max(case when symbol = '1-URGENT' then close end) - max(case when symbol = '5-LOW' then close end) as s from px_day group by date)\nselect date, " + _round("s / 10000", "spread", 4) + ", case when s is null then null when s / 10000 < 0 then 'inverted' when s / 10000 >= 1 then 'steep' when s / 10000 <= 0.2 then 'flat' else 'normal' end as state from a", "px_day"))
def _(p):
    s = (F.col("p1") - F.col("p5")) / 10000
    return _curve(p).select("date", rounded(s, 4).alias("spread"), ln.curve_state(s).alias("state"))


@query("w30_rolling_betas")
def _(p):
    """Betas over 60 days on the benchmark and its lag, cleaned within each window."""
    d = _pairs(p).withColumn("b1", F.lag("b").over(_w()))
    return ln.rolling_betas(d, "r", ["b", "b1"], 60, "string")




@query(
    "x24_registered_factors",
    with_views(
        "r as (select symbol, date, close, close / nullif(lag(close) over w, 0) - 1 as r from px_month window w as (partition by symbol order by date))\n"
        f"select symbol, date, 'momentum_12_1' as factor, {_round('lag(close, 1) over w / nullif(lag(close, 12) over w, 0) - 1', 'value')} from r window w as (partition by symbol order by date)\n"
        f"union all select symbol, date, 'reversal_1', {_round('-r', 'value')} from r\n"
        f"union all select symbol, date, 'volatility_12', {_round('case when count(r) over v >= 12 then stddev_samp(r) over v end * sqrt(252.0)', 'value')} from r window v as (partition by symbol order by date rows between 11 preceding and current row)",
        "px_month",
    ),
)
def _(p):
    """The factors that come with the engine, by their registry."""
    from ..operators.plugins import FACTORS

    return FACTORS.compute(p.px_month, [*FACTORS.named("price"), *FACTORS.named("risk")]).withColumn("value", rounded("value"))
