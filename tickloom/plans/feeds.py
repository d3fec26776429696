"""Text, date and stream queries: f, s12 to s15 and t."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions.columns import by, change, rounded
from ..operators import fundamentals as fu
from ..operators import portfolio as pf
from ..operators import text as tx
from ..sources import feeds as fd
from ..sources import tables as tb
from ..sources.panels import with_views
from ..streaming import incremental as inc
from .aggregates import _round
from .registry import query

def _w():
    """The panel window; made per use, since a window needs a session."""
    return by("symbol", order="date")

_TRACK = " or ".join(f"starts_with(k, '{t}')" if t.endswith("_") else f"k = '{t}'" for t in tx.TRACKING)


@query(
    "f1_normalise_url",
    f"""with u as (select page_id, regexp_replace(regexp_replace(url, '/+$', ''), '#.*$', '') as u from pages),
p as (select page_id, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://)', 1)) as head, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)', 1)), '^www\\.', '') as site,
  regexp_replace(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?([^?]*)', 1), '/index\\.html$', '') as path,
  list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')) as q from u),
n as (select *, list_filter(list_transform(q, lambda x: {{'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}}), lambda s: not ({_TRACK.replace('starts_with(k,', 'starts_with(s.k,').replace('k = ', 's.k = ')})) as kv from p),
o as (select *, list_sort(list_transform(range(1, len(kv) + 1), lambda i: {{'p': list_position(list_transform(kv, lambda s: s.k), kv[i].k), 'i': i, 'x': replace(url_encode(kv[i].k), '%20', '+') || '=' || replace(url_encode(kv[i].v), '%20', '+')}})) as z from n),
k as (select page_id, head, site, path, array_to_string(list_transform(z, lambda s: s.x), '&') as q from o)
select page_id, head || site || path || case when coalesce(q, '') <> '' then '?' || q else '' end as url from k""",
)
def _(p):
    return p.table("pages").select("page_id", tx.normalise_url("url").alias("url"))


@query("f2_title_similarity", with_views(", t as (select item_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> '')) as ws from items), n as (select *, lead(ws) over (order by item_id) as nx from t)\nselect item_id, case when nx is null then null when len(ws) = 0 or len(nx) = 0 then 0 else round(len(list_intersect(ws, nx)) / len(list_distinct(list_concat(ws, nx)))::double + 1e-8, 6) end as similarity from n", "items"))
def _(p):
    other = p.items.select((F.col("item_id") - 1).alias("item_id"), F.col("title").alias("following"))
    d = p.items.join(other, "item_id", "left")
    return d.select("item_id", F.when(F.col("following").isNotNull(), F.when(tx.title_similarity("title", "following") == 0, 0.0).otherwise(rounded(tx.title_similarity("title", "following")))).alias("similarity"))


@query("f3_domain", r"select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') as domain from pages")
def _(p):
    return p.table("pages").select("page_id", tx.domain("url").alias("domain"))


def _hits_sql(text: str, words: list[str]) -> str:
    return "len(list_filter([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"], lambda w: contains({text}, w)))"


def _category_sql() -> str:
    cases = "".join(f" when h{i} > 0 then {{'c': '{n}', 'v': least(h{i} * 0.25, 1.0)}}" for i, n in enumerate(tx.CATEGORIES))
    hits = ", ".join(f"{_hits_sql('t', w)} as h{i}" for i, w in enumerate(tx.CATEGORIES.values()))
    return f"with d as (select doc_id, lower(text) as t from documents), h as (select doc_id, {hits} from d), r as (select doc_id, case{cases} else {{'c': 'other', 'v': 0.0}} end as x from h) select doc_id, x.c as category, x.v::double as confidence from r"


@query("f4_categorise", _category_sql())
def _(p):
    return p.table("documents").select("doc_id", tx.categorise(F.col("text")).alias("x")).select("doc_id", "x.category", "x.confidence")


@query("f5_paywall", f"with d as (select doc_id, length(text) as n, {_hits_sql('lower(text)', tx.PAYWALL)} as h, text from documents) select doc_id, (n < 200 and h >= 1) or (n < 1500 and h >= 2) as paywalled, length(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))) as clean_chars from d")
def _(p):
    return p.table("documents").select("doc_id", tx.paywalled("text").alias("paywalled"), F.length(tx.clean_lines("text")).cast("long").alias("clean_chars"))


@query("f6_article_text")
def _(p):
    """Text of the article element of every page."""
    return fd.article_texts(p.table("pages"), "page_id", "html")


@query("f7_collapse", "select doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '[^\\S\\n]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as chars, strlen(text) > 10000 as large from documents")
def _(p):
    return p.table("documents").select("doc_id", F.length(tx.collapse("text")).cast("long").alias("chars"), (F.octet_length("text") > 10000).alias("large"))


@query(
    "f8_sections",
    """with d as (select page_id, html, instr(html, '<nav>') as a, instr(html, '<article>') as b, instr(html, '<footer>') as c from pages),
s as (select page_id, html, unnest([{'n': 'menu', 'p': a}, {'n': 'main', 'p': b}, {'n': 'foot', 'p': c}]) as s, a, b, c from d)
select page_id, s.n as section, cast(s.p as integer) as position, length(case s.n when 'menu' then html[a:case when b > 0 then b when c > 0 then c else length(html) + 1 end - 1] when 'main' then html[b:case when c > 0 then c else length(html) + 1 end - 1] else html[c:] end) as chars from s where s.p > 0""",
)
def _(p):
    s = tx.sections(p.table("pages"), "html", {"menu": "<nav>", "main": "<article>", "foot": "<footer>"}, "page_id")
    return s.select("page_id", "section", "position", F.length("content").cast("long").alias("chars"))


_TALK = "'<' || role || ' speaker' || turn || '>' || text || case when turn % 2 = 0 then ' ---' else '' end || '</' || role || '>'"


@query("f10_transcript", "select conv_id, turn::bigint as at, role as kind, 'speaker' || turn as speaker, length(trim(text)) as chars, 'Q' || (1 + turn % 4) || ' 20' || lpad(cast(conv_id % 100 as varchar), 2, '0') as period from conversations where trim(text) <> ''")
def _(p):
    turn = F.col("turn").cast("string")
    tail = F.when(F.col("turn") % 2 == 0, " ---").otherwise("")
    marked = F.concat(F.lit("<"), F.col("role"), F.lit(" speaker"), turn, F.lit(">"), F.col("text"), tail, F.lit("</"), F.col("role"), F.lit(">"))
    head = F.concat(F.lit("Results for Q"), (F.col("turn") % 4 + 1).cast("string"), F.lit(" 20"), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0"), F.lit(" call"))
    d = p.table("conversations").select("conv_id", F.col("turn").cast("long").alias("at"), F.explode(tx.transcript_sections(marked)).alias("s"), tx.fiscal_period(head, F.lit(2020), F.lit(5)).alias("period"))
    return d.select("conv_id", "at", "s.kind", "s.speaker", F.length("s.content").cast("long").alias("chars"), "period")


@query("f11_ticker", "select p_partkey, case p_partkey % 5 when 0 then p_size || '' when 1 then p_size || '.T' when 2 then p_size || '.L' when 3 then p_size || ' ZZ Equity' else 'X' || p_size end as ticker from part")
def _(p):
    k = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(size, F.lit(" UW Equity"))).when(k == 1, F.concat(size, F.lit(" JT Equity"))).when(k == 2, F.concat(F.lit(" "), size, F.lit(" ln Equity"))).when(k == 3, F.concat(size, F.lit(" ZZ Equity"))).otherwise(F.concat(F.lit("X"), size))
    return p.table("part").select("p_partkey", tx.convert_ticker(raw).alias("ticker"))


@query(
    "f12_dates",
    """with d as (select distinct cast(o_orderdate as date) as d from orders)
select d, d - cast(((isodow(d) - 2 + 7) % 7) as integer) as previous_tuesday, d - cast(((isodow(d) - 2 + 7) % 7) as integer) - 7 as last_tuesday,
cast(len(list_filter(generate_series(date_trunc('month', d), d, interval 1 day), lambda x: isodow(x) < 6)) as integer) as weekdays, strftime(d, '%m/%d/%Y') as us,
year(d) || '年' || month(d) || '月' || day(d) || '日(' || ['月','火','水','木','金','土','日'][isodow(d)] || ')' as ja, case when day(d) % 4 = 3 then date '1900-01-01' else d end as parsed from d""",
)
def _(p):
    d = p.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    k = F.dayofmonth("d") % 4
    written = F.when(k == 0, F.date_format("d", "yyyy-MM-dd")).when(k == 1, F.date_format("d", "yyyyMMdd")).when(k == 2, F.date_format("d", "MM/dd/yyyy")).otherwise("31. Dez.")
    return d.select("d", dt.previous_tuesday("d").alias("previous_tuesday"), dt.last_tuesday("d").alias("last_tuesday"), dt.weekdays_between(F.trunc("d", "month"), "d").alias("weekdays"), dt.american("d").alias("us"), dt.japanese("d").alias("ja"), F.coalesce(dt.parse(written), F.lit("1900-01-01").cast("date")).alias("parsed"))


@query("f13_preset_period", "with m as (select cast(max(o_orderdate) as date) as d from orders) select " + ", ".join(f"cast(d - interval {y} year as date) as start_{n}" for n, y in (("1y", 1), ("3y", 3), ("5y", 5), ("10y", 10), ("max", 30))) + ", cast(date_trunc('year', d) as date) as start_ytd from m")
def _(p):
    m = p.table("orders").agg(F.max("o_orderdate").cast("date").alias("d"))
    return m.select(*[dt.preset_start("d", n).alias(f"start_{n}") for n in ("1y", "3y", "5y", "10y", "max", "ytd")])


@query("f14_drift", "with t as (select s_suppkey, s_nationkey / 100.0 as target, (s_nationkey % 7) / 50.0 as current from supplier) select s_suppkey, round(current - target + 1e-8, 6) as drift, case when abs(target) > 1e-6 then round((current - target) / target * 100 + 1e-6, 4) when current - target > 0 then null else 0 end as pct, abs(round(current - target, 10)) >= 0.05 as rebalance from t")
def _(p):
    now, goal = (F.col("s_nationkey") % 7) / 50.0, F.col("s_nationkey") / 100.0
    d, pct, flag = pf.drift(F.round(now, 10), F.round(goal, 10))
    return p.table("supplier").select("s_suppkey", rounded(d).alias("drift"), F.when(F.abs(pct) != float("inf"), rounded(pct, 4)).alias("pct"), (F.abs(F.round(d, 10)) >= 0.05).alias("rebalance"))


@query("f15_normalise_weights", "select s_suppkey, round(w / sum(w) over () + 1e-10, 8) as weight from (select s_suppkey, abs(s_acctbal) as w from supplier)")
def _(p):
    w = p.table("supplier").select("s_suppkey", F.abs("s_acctbal").alias("weight"))
    return pf.normalised(w, "weight").withColumn("weight", rounded("weight", 8))


_BAND = "case when s >= 80 then 90 when s >= 60 then 70 when s >= 40 then 50 when s >= 20 then 30 else 10 end"


@query(
    "f16_claim_rules",
    f"""with c as (select p_partkey, p_partkey % 2 = 0 as st, p_partkey % 3 = 0 as co, p_partkey % 5 < 3 as qu, p_partkey % 7 < 3 as cm from part),
s as (select p_partkey, greatest(10, least(90, 50 + case when st then 0 else -30 end + case when st then 0 else -10 end + case when not co then 0 else -30 end + case when qu then 20 else -10 end + case when st then 10 else -10 end + case when cm then 15 else -10 end + case when st then 0 else -20 end + case when st and cm and qu then 30 else 0 end)) as s from c)
select p_partkey, cast(s as integer) as score, cast({_BAND} as integer) as confidence, case p_partkey % 4 when 0 then 'brand_power' when 1 then 'cost_advantage' when 2 then 'intangible_assets' else 'none' end as moat, case when p_partkey % 2 = 0 then 'low' else 'high' end as intensity from s""",
)
def _(p):
    k = F.col("p_partkey")
    s = tx.claim_confidence(k % 2 == 0, k % 3 == 0, k % 5 < 3, k % 7 < 3)
    claim = F.when(k % 4 == 0, "Strong Brand").when(k % 4 == 1, "economies of scale").when(k % 4 == 2, "Patent wall").otherwise("nothing")
    low, high = F.when(k % 2 == 0, "low").otherwise("high"), F.when(k % 2 == 0, "high").otherwise("low")
    return p.table("part").select("p_partkey", s.cast("int").alias("score"), tx.confidence_band(s).cast("int").alias("confidence"), tx.moat_kind(claim, F.lit("")).alias("moat"), tx.five_forces(high, high, low, low, low).alias("intensity"))


@query("f18_cache_key", "select c_custkey, sha256(c_custkey || ':' || c_name || ':' || c_mktsegment) as key from customer")
def _(p):
    return p.table("customer").select("c_custkey", tx.cache_key(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("f19_company_arithmetic", with_views("select symbol, date, " + ", ".join([_round("quantity / (quantity + 100) * 0.08 + 100 / (quantity + 100) * 0.04 * 0.7", "wacc"), _round("(discount - tax) * quantity", "profit", 4), _round("(price - lag(price, 3) over w) / nullif(quantity - lag(quantity, 3) over w, 0)", "incremental", 3), _round("discount / nullif(price, 0) * (price / nullif(quantity, 0)) * (quantity / nullif(tax, 0))", "dupont", 4), _round("case when count(quantity) over w12 >= 12 then sum(quantity) over w12 end", "capitalised", 2)]) + " from metrics window w as (partition by symbol order by date), w12 as (partition by symbol order by date rows between 11 preceding and current row)", "metrics"))
def _(p):
    c = F.col
    w = fu.wacc(c("quantity"), F.lit(100.0), F.lit(0.08), F.lit(0.04), F.lit(0.3))
    *_rest, product = fu.dupont(c("discount"), c("price"), c("quantity"), c("tax"))
    return p.metrics.select(
        "symbol", "date", rounded(w).alias("wacc"), rounded(fu.economic_profit(c("discount"), c("tax"), c("quantity")), 4).alias("profit"),
        rounded(fu.incremental_roic("price", "quantity", _w(), 3), 3).alias("incremental"), rounded(product, 4).alias("dupont"), rounded(fu.capitalised("quantity", _w(), 12), 2).alias("capitalised"),
    )


_REGIME = "g as (select date, case when bench > (select median(bench) from bench_month) then 'High' else 'Low' end as level, bench - lag(bench, 12) over (order by date) as moved from bench_month), h as (select date, coalesce(level || case when moved > 0 then ' & Rising' when moved <= 0 then ' & Falling' end, 'Unknown') as regime from g)"


@query("f20_regimes", with_views(_REGIME + f"\nselect regime, count(r) as n, {_round('avg(r) * 12', 'annual')}, {_round('stddev_samp(r) * sqrt(12)', 'volatility')}, {_round('avg(r) * 12 / (stddev_samp(r) * sqrt(12))', 'sharpe')} from ret_month join h using (date) group by regime", "bench_month", "ret_month"))
def _(p):
    r = p.px_month.select("symbol", "date", change("close", 1, _w()).alias("r"))
    g = fu.by_regime(r, fu.regimes(p.bench_month, "bench"))
    return g.select("regime", "n", *[rounded(c).alias(c) for c in ("annual", "volatility", "sharpe")])


@query("f21_history_percentile", with_views("x as (select *, max_by(close, date) over (partition by symbol) as now from px_month)\nselect symbol, " + _round("max(now)", "now", 4) + ", " + _round("case when count(close) > 10 then avg(case when close < now then 1.0 else 0 end) * 100 end", "percentile") + " from x group by symbol", "px_month"))
def _(p):
    h = fu.history_percentile(p.px_month, "close", ["symbol"])
    return h.select("symbol", rounded("now", 4).alias("now"), rounded("percentile").alias("percentile"))


@query("s12_feed_items", "select 'f' || (page_id // 100) as feed_id, 'g' || page_id as item_id, url as link from pages")
def _(p):
    """All pages, a hundred ids to a feed, written as XML and parsed back."""
    safe = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    item = F.concat(F.lit("<item><guid>g"), F.col("page_id").cast("string"), F.lit("</guid><link>"), safe, F.lit("</link></item>"))
    d = p.table("pages").groupBy(F.floor(F.col("page_id") / 100).alias("k")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    xml = F.concat(F.lit("<rss><channel><title>x</title>"), F.col("items"), F.lit("</channel></rss>"))
    return fd.feed_items(d.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feed_id"), xml.alias("xml"))).select("feed_id", "item_id", "link")


@query("s13_table_cells", "select n_nationkey, n_name as cell from nation")
def _(p):
    html = F.concat(F.lit("<table><tr><th>k</th></tr><tr class='x'><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), F.col("n_name"), F.lit("</b> </td></tr></table>"))
    cells = fd.table_cells(html)
    return p.table("nation").select(cells[1][0].cast("int").alias("n_nationkey"), cells[1][1].alias("cell"))


@query("s14_json_records", "select c_custkey, c_name as name, c_acctbal as balance from customer")
def _(p):
    text = F.concat(F.lit("["), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))), F.lit(", ]"))
    return fd.json_records(p.table("customer").select("c_custkey", text.alias("text")), "text", "name string, balance double").drop("text")


def _replay(p):
    """Events as about ten files that arrive in the order of time: one task writes them one after the other. The folder
    also holds the stream's table and state."""
    root = tb.work_dir(p.spark, "events")
    e = p.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.coalesce(1).sortWithinPartitions("ts", "event_id").write.option("maxRecordsPerFile", max(1, e.count() // 10)).parquet(f"{root}/in")
    return inc.file_stream(p.spark, f"{root}/in", e.schema), f"{root}/out"


@query("t1_stream_dedup", "select distinct user_id from events")
def _(p):
    """Users, each once, over a retention longer than the data."""
    stream, path = _replay(p)
    return inc.run_to_table(inc.deduplicated(stream, "ts", "user_id", "60 days"), path).select("user_id")


@query("t1_stream_dedup_sliding", "select user_id, event_id from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events) where before is null or ts > before + interval 24 hours")
def _(p):
    """Events of users not seen for a day before."""
    stream, path = _replay(p)
    return inc.run_to_table(inc.deduplicated_sliding(stream, "ts", "user_id", 24), path).select("user_id", "event_id")


@query("t2_new_items", "select user_id, event_type from events group by 1, 2")
def _(p):
    stream, path = _replay(p)
    keyed = stream.select("user_id", "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("link"))
    return inc.run_to_table(inc.new_items(keyed, "link"), path).select("user_id", "event_type")


@query("t3_incremental_series", "select event_type, cast(ts as date) as date, max_by(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def _(p):
    stream, path = _replay(p)
    seq = F.unix_micros("ts") * 1000 + F.col("event_id") % 1000
    rows = stream.select("event_type", F.col("ts").cast("date").alias("date"), "event_id", seq.alias("seq"))
    table = inc.Series(p.spark, path, rows.schema, ["event_type", "date"])
    table.run(rows)
    return table.now()


@query("t6_ttl_cache", "with l as (select user_id as key, max_by(event_id, (ts, event_id)) as value, max(ts) as stored_at from events group by 1), n as (select max(ts) as now from events) select key, value from (select key, value, row_number() over (order by stored_at desc, key) as k from l, n where stored_at > now - interval 20 days) where k <= 100")
def _(p):
    """The hundred newest of the live entries: an entry lives for twenty days from when it was stored last."""
    e = p.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").cast("timestamp").alias("stored_at"))
    now = e.agg(F.max("stored_at")).first()[0]
    order = F.struct("stored_at", "value")
    last = e.groupBy("key").agg(F.max_by("value", order).alias("value"), F.max("stored_at").alias("stored_at"))
    return tb.live_entries(last, now, 20 * 24 * 3600, 100).select("key", "value")


@query("t7_resume_point", with_views("select symbol, max(date) as last from px_day group by symbol", "px_day"))
def _(p):
    return inc.resume_point(p.px_day, "date", ["symbol"])


@query("s15_transcripts", "select conv_id, cast(turn as integer) as turn, role, text from conversations")
def _(p):
    """Conversations written as JSON arrays with trailing commas, one file's text a row, and read back."""
    turn = F.struct(F.col("turn").cast("int").alias("turn"), "role", "text")
    d = p.table("conversations").groupBy("conv_id").agg(F.collect_list(F.to_json(turn)).alias("turns"))
    text = F.concat(F.lit("[\n"), F.array_join("turns", ",\n"), F.lit(",\n]"))
    return fd.json_records(d.select("conv_id", text.alias("doc")), "doc", "turn int, role string, text string").drop("doc")
