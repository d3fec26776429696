"""Scans, sinks, cleaning, joins and set operations: s, k, p, j and u queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import by, change, clip, finite, rounded, safe_div
from ..operators import cleaning as cl
from ..operators import indicators as ind
from ..operators import joins as jn
from ..sources import tables as tb
from ..sources.panels import with_views
from .registry import query

def _w():
    """The panel window; made per use, since a window needs a session."""
    return by("symbol", order="date")


@query("s1_parquet_scan", "select r_regionkey, r_name from region")
def _(p):
    return tb.scan(p.spark, f"{p.folder}/region.parq*").select("r_regionkey", "r_name")


_S2 = "select o_orderstatus, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by o_orderstatus"


@query("s2_sql", _S2)
def _(p):
    return tb.run_sql(p.spark, _S2, {"orders": p.table("orders")})


@query("s3_execute", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey <> 2 union all select 100, 'NOWHERE', 9")
def _(p):
    """A table made, filled, and rewritten by statements."""
    name, path = f"nations_{uuid.uuid4().hex[:12]}", tb.work_dir(p.spark, "nations")
    p.table("nation").createOrReplaceTempView(f"all_{name}")
    out = tb.execute(
        p.spark,
        f"create table {name} (n_nationkey int, n_name string, n_regionkey int) using parquet location '{path}'",
        f"insert into {name} select n_nationkey, n_name, n_regionkey from all_{name} where n_regionkey <> 2",
        f"insert into {name} values (100, 'NOWHERE', 9)",
        f"drop view all_{name}",
        f"drop table {name}",
    )
    assert len(out) == 5
    return p.spark.read.parquet(path)


@query("s4_bound_sql", "select n_nationkey, n_name from nation where n_regionkey = 2")
def _(p):
    return tb.run_sql(p.spark, "select n_nationkey, n_name from nation_v where n_regionkey = :region", {"nation_v": p.table("nation")}, {"region": 2})


@query("s5_filtered_facts", with_views("select symbol, date, variable, round(value + 1e-6, 4) as value from facts where date between date '1997-01-01' and date '1998-12-31' and symbol in (1, 2, 3, 5, 8)", "facts"))
def _(p):
    return tb.filtered_facts(p.facts, "1997-01-01", "1998-12-31", [1, 2, 3, 5, 8]).withColumn("value", rounded("value", 4))


@query("s6_union_pivot", with_views("select symbol, date, round(discount + 1e-8, 6) as discount, round(tax + 1e-8, 6) as tax from metrics", "metrics"))
def _(p):
    parts = [p.facts.where(F.col("variable") == v) for v in ("discount", "tax")]
    return tb.union_pivot(parts, ["discount", "tax"]).select("symbol", "date", rounded("discount").alias("discount"), rounded("tax").alias("tax"))


@query("s7_membership", with_views("select symbol, sector from sectors", "sectors"))
def _(p):
    return p.sectors


@query("s8_json_records")
def _(p):
    """Nested records written as JSON and read back with nested values as strings."""
    path = tb.work_dir(p.spark, "records")
    nested = p.table("customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("detail"), F.array("c_mktsegment").alias("segments"))
    tb.write_json(nested, path)
    return tb.read_json_records(p.spark, path)


@query("k1_write_parquet", "select n_nationkey, n_name, n_regionkey from nation")
def _(p):
    path = tb.work_dir(p.spark, "nation")
    tb.write_parquet(p.table("nation"), path)
    return tb.scan(p.spark, path)


@query("k2_split_parquet", with_views("select symbol, date, round(close + 1e-6, 4) as close, cast(floor(year(date) / 3.0) * 3 as integer) as year_bucket from px_day", "px_day"))
def _(p):
    path = tb.work_dir(p.spark, "years")
    tb.write_by_years(p.px_day, path)
    return tb.scan(p.spark, path).select("symbol", "date", rounded("close", 4).alias("close"), "year_bucket")


@query("k3_parquet_to_json", "select r_regionkey::bigint as r_regionkey, r_name from region")
def _(p):
    path = tb.work_dir(p.spark, "region")
    tb.write_json(p.table("region"), path)
    return p.spark.read.json(path).select("r_regionkey", "r_name")


@query("k4_export_csv", "select n_nationkey, n_name from nation")
def _(p):
    path = tb.work_dir(p.spark, "csv")
    tb.write_csv(p.table("nation").select("n_nationkey", "n_name"), path)
    return p.spark.read.option("header", "true").schema("n_nationkey int, n_name string").csv(path)


_NEW = "(select o_orderkey as id, o_orderstatus as status, o_totalprice as price, o_orderkey as seq from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'X', o_totalprice + 1, o_orderkey + 100000000 from orders where o_orderkey % 6 = 0)"
_OLD = "(select o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 2 = 0)"


def _old_new(p):
    o = p.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    third, sixth = o.where("id % 3 = 0"), o.where("id % 6 = 0")
    new = third.withColumn("seq", F.col("id")).unionByName(sixth.select("id", F.lit("X").alias("status"), (F.col("price") + 1).alias("price"), (F.col("id") + 100_000_000).alias("seq")))
    return o.where("id % 2 = 0"), new


@query("k5_upsert", f"select id, status, round(price + 1e-6, 4) as price from (select *, row_number() over (partition by id order by seq desc) as n from (select *, -1 as seq from {_OLD} union all select * from {_NEW})) where n = 1")
def _(p):
    return tb.upsert(*_old_new(p), ["id"]).withColumn("price", rounded("price", 4))


@query("k6_insert_absent", f"select id, status, round(price + 1e-6, 4) as price, seq from (select *, row_number() over (partition by id order by seq) as n from {_NEW}) where n = 1 and id not in (select id from {_OLD})")
def _(p):
    old, new = _old_new(p)
    return tb.insert_absent(old, new, ["id"], "seq").withColumn("price", rounded("price", 4))


@query("p1_normalise_ohlcv", with_views("select symbol, date, cast(null as double) as open, round(close + 1 + 1e-6, 4) as high, cast(null as double) as low, round(close + 1e-6, 4) as close, cast(null as double) as volume from px_day", "px_day"))
def _(p):
    raw = p.px_day.select(F.col("symbol").alias("Symbol"), F.col("date").alias("Date"), rounded(F.col("close") + 1, 4).alias("High"), rounded("close", 4).alias("Adj Close"))
    return cl.normalise_ohlcv(raw)


@query("p2_date_range", with_views("select symbol, date, round(close + 1e-6, 4) as close from px_day where date between date '1996-03-01' and date '1996-05-31'", "px_day"))
def _(p):
    return p.px_day.where(F.col("date").between("1996-03-01", "1996-05-31")).withColumn("close", rounded("close", 4))


@query("p3_point_in_time", with_views("select count(*) filter (where date > date '1998-06-30') as late, count(*) filter (where date > date '1998-06-30') = 0 as compliant, (select count(*) from px_day where date <= date '1998-06-30') as known from px_day", "px_day"))
def _(p):
    known = cl.known_by(p.px_day, "date", "1998-06-30").agg(F.count("*").alias("known"))
    return cl.compliant(p.px_day, "date", "1998-06-30").join(F.broadcast(known))


_TEXTS = """select p_partkey, case when p_partkey % 7 = 0 then 'N/A' when p_partkey % 11 = 0 then ' ' when p_partkey % 13 = 0 then 'abc'
  else '$' || cast(p_partkey as varchar) || ',' || lpad(cast(p_size as varchar), 3, '0') || '.5' end as price, cast(p_size as varchar) || '%' as pct from part"""


@query("p4_clean_numbers", f"select p_partkey, case when trim(price) not in ('', 'N/A', 'NA', 'n/a') then try_cast(regexp_replace(trim(price), '[$,%\\s]', '', 'g') as double) end as price, try_cast(replace(pct, '%', '') as double) as pct, try_cast(replace(pct, '%', '') as bigint) as n from ({_TEXTS})")
def _(p):
    k = F.col("p_partkey")
    money = F.concat(F.lit("$"), k.cast("string"), F.lit(","), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5"))
    raw = p.table("part").select(k, F.when(k % 7 == 0, "N/A").when(k % 11 == 0, " ").when(k % 13 == 0, "abc").otherwise(money).alias("price"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("pct"))
    return raw.select("p_partkey", cl.clean_number("price").alias("price"), cl.clean_number("pct").alias("pct"), cl.clean_count("pct").alias("n"))


@query("p5_snake_case", "select p_partkey, lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as name from (select p_partkey, 'marketCap' || cast(p_size as varchar) || 'Of' || p_brand as x from part)")
def _(p):
    x = F.concat(F.lit("marketCap"), F.col("p_size").cast("string"), F.lit("Of"), F.col("p_brand"))
    return p.table("part").select("p_partkey", cl.snake_case(x).alias("name"))


@query("p6_validate", "select * from (values ('o_missing', 'missing', 1::bigint), ('o_custkey', 'type bigint instead of int', 1), ('half', 'null key', (select count(*) from orders where o_orderkey % 2 = 1))) t(\"column\", problem, n)")
def _(p):
    df = p.table("orders").withColumn("half", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")))
    return tb.validate(df, {"o_orderkey": "bigint", "o_missing": "string", "o_custkey": "int"}, ["o_orderkey", "half"])


@query("p7_collector_check", "select false as empty, 1::bigint as missing_columns, (select count(*) from customer where c_acctbal < 0) as negatives")
def _(p):
    return tb.collector_check(p.table("customer"), ["c_custkey", "c_phone"], ["c_acctbal"])


@query("p8_blocked_domains", r"""with h as (select page_id as item_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from pages)
select item_id, host from h where not (host = 'ads-track.example.com' or host like '%.ads-track.example.com' or host = 'example.org' or host like '%.example.org')""")
def _(p):
    blocked = p.spark.createDataFrame([("ads-track.example.com",), ("example.org",)], "domain string")
    kept = cl.drop_blocked(p.items, "link", F.broadcast(blocked))
    return kept.select("item_id", cl.host("link").alias("host"))


@query("p9_recent", "select event_id, event_type from events where ts >= (select max(ts) from events) - interval 48 hours")
def _(p):
    e = p.table("events")
    now = e.agg(F.max("ts").alias("now"))
    return cl.recent(e.join(F.broadcast(now)), "ts", F.col("now"), 48).select("event_id", "event_type")


@query("p10_keyword", with_views("select item_id from items where contains(lower(title), 'tion') or contains(lower(link), 'blog')", "items"))
def _(p):
    return p.items.where(cl.mentions("Tion", "title") | cl.mentions("blog", "link")).select("item_id")


@query("p11_drop_missing", with_views("select symbol, date, round(ret + 1e-8, 6) as ret from (select symbol, date, close / nullif(lag(close, 3) over (partition by symbol order by date), 0) - 1 as ret from px_month) where ret is not null", "px_month"))
def _(p):
    r = p.px_month.select("symbol", "date", change("close", 3, _w()).alias("ret"))
    return r.dropna(how="any", subset=["ret"]).withColumn("ret", rounded("ret"))


@query("p12_finite", "select p_partkey, case when p_size % 5 = 0 then null else p_retailprice end as price from part")
def _(p):
    x = F.when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice"))
    return p.table("part").select("p_partkey", finite(x).alias("price"))


@query("p13_clip", "select c_custkey, greatest(0.0, least(5000.0, c_acctbal)) as balance from customer")
def _(p):
    return p.table("customer").select("c_custkey", clip("c_acctbal", 0.0, 5000.0).alias("balance"))


@query("p14_check_weights", with_views(", w as (select symbol, close / sum(close) over () as weight from px_day where date = date '1996-01-02')\nselect count(*) filter (where weight < 0 or weight > 1) as outside, abs(sum(weight) - 1) <= 1e-6 as sums_to_one from w", "px_day"))
def _(p):
    day = p.px_day.where(F.col("date") == "1996-01-02")
    total = day.agg(F.sum("close").alias("total"))
    return cl.check_weights(day.join(F.broadcast(total)).withColumn("weight", safe_div("close", "total")), "weight")


@query("j1_align", with_views("select date, symbol, round(r + 1e-8, 6) as r, round(b + 1e-8, 6) as b from ret_day join bret_day using (date) where r is not null and b is not null", "ret_day", "bret_day"))
def _(p):
    a = p.px_day.select("date", "symbol", change("close", 1, _w()).alias("r"))
    b = p.bench_day.select("date", change("bench", 1, by(order="date")).alias("b"))
    return jn.align(a, b, ["date"]).select("date", "symbol", rounded("r").alias("r"), rounded("b").alias("b"))


@query("j2_left_lookup", with_views("select symbol, date, sector from px_month left join (select * from sectors where symbol % 2 = 0) using (symbol)", "px_month", "sectors"))
def _(p):
    return p.px_month.join(p.sectors.where("symbol % 2 = 0"), "symbol", "left").select("symbol", "date", "sector")


@query("j3_weighted_left", with_views("select w.symbol, w.date, w.weight, round(m.discount + 1e-8, 6) as discount from (select symbol, date, quantity as weight from metrics where symbol % 3 = 0) w left join (select * from metrics where month(date) <> 6) m using (symbol, date)", "metrics"))
def _(p):
    weights = p.metrics.select("symbol", "date", F.when(F.col("symbol") % 3 == 0, F.col("quantity")).alias("weight"))
    values = p.metrics.where(F.month("date") != 6).select("symbol", "date", rounded("discount").alias("discount"))
    return jn.weighted_left(weights, values, ["symbol", "date"])


_TWO = """,
a as (select date, close as x from px_day where symbol = '1-URGENT'), b as (select date, close as y from px_day where symbol = '5-LOW')
"""


def _two(p):
    a = p.px_day.where(F.col("symbol") == "1-URGENT").select("date", F.col("close").alias("x"))
    return a, p.px_day.where(F.col("symbol") == "5-LOW").select("date", F.col("close").alias("y"))


def _filled_sql(how: str) -> str:
    return with_views(_TWO + f"\nselect date, round(last_value(x ignore nulls) over (order by date rows unbounded preceding) + 1e-6, 4) as x, round(last_value(y ignore nulls) over (order by date rows unbounded preceding) + 1e-6, 4) as y from a {how} join b using (date)", "px_day")


@query("j4_outer_filled", _filled_sql("full"))
def _(p):
    return jn.outer_filled(*_two(p), "date", "x", "y").select("date", rounded("x", 4).alias("x"), rounded("y", 4).alias("y"))


@query("j5_left_filled", _filled_sql("left"))
def _(p):
    return jn.outer_filled(*_two(p), "date", "x", "y", how="left").select("date", rounded("x", 4).alias("x"), rounded("y", 4).alias("y"))


@query("j6_anti_semi", "select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as has_f from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(p):
    o = p.table("orders")
    c = p.table("customer").select("c_custkey")
    lone = c.join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_f", F.lit(True))
    return lone.join(f, "c_custkey", "left").select("c_custkey", F.coalesce("has_f", F.lit(False)).alias("has_f"))


@query("j7_new_items", with_views("select min(item_id) as item_id, link from items where link not in (select link from items where item_id < 50) group by link", "items"))
def _(p):
    return tb.insert_absent(p.items.where("item_id < 50"), p.items, ["link"], "item_id").select("item_id", "link")


@query("j8_coalesced_lookup", "select s_suppkey, case when s_suppkey % 2 = 0 then s_suppkey * 10 when s_nationkey % 3 = 0 then s_nationkey * 1000 end as code from supplier")
def _(p):
    s = p.table("supplier").select("s_suppkey", "s_nationkey")
    local = s.where("s_suppkey % 2 = 0").select("s_suppkey", (F.col("s_suppkey") * 10).alias("code"))
    other = p.table("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 1000).cast("long").alias("code"))
    return jn.coalesced_lookup(s, [(local, "s_suppkey"), (other, "s_nationkey")], "code").select("s_suppkey", "code")


@query("j9_known_sector", with_views("select symbol, date, sector from px_month join (select * from sectors where sector <> 'ASIA') using (symbol)", "px_month", "sectors"))
def _(p):
    return p.px_month.join(p.sectors.where("sector <> 'ASIA'"), "symbol").select("symbol", "date", "sector")


@query("j10_densify", with_views("select symbol, date, round(close + 1e-6, 4) as close from (select symbol, date from (select distinct symbol from px_month), (select distinct date from px_month)) left join px_month using (symbol, date)", "px_month"))
def _(p):
    return ind.densify(p.px_month, p.px_month.select("date").distinct()).select("symbol", "date", rounded("close", 4).alias("close"))


@query("j11_common_axes", with_views("select a.symbol, a.date from (select symbol, date from px_month where symbol % 2 = 0) a join (select symbol, date from metrics where year(date) = 1997) b using (symbol, date)", "px_month", "metrics"))
def _(p):
    return p.px_month.where("symbol % 2 = 0").select("symbol", "date").join(p.metrics.where(F.year("date") == 1997).select("symbol", "date"), ["symbol", "date"])


@query(
    "j12_first_similar",
    with_views(
        """,
t as (select item_id, link, list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> '')) as ws from items)
select a.item_id, min(b.item_id) as first from t a join t b on (a.link = b.link or len(list_intersect(a.ws, b.ws)) >= 0.85 * len(list_distinct(list_concat(a.ws, b.ws))) and len(a.ws) > 0)
group by a.item_id""",
        "items",
    ),
)
def _(p):
    return jn.first_similar(p.items, p.items)


@query("u1_union", "select r_regionkey as k, r_name as name from region union all select n_nationkey, n_name from nation")
def _(p):
    return p.table("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).unionByName(p.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


@query("u2_first_per_key", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def _(p):
    return tb.latest(p.table("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], -F.col("o_orderkey"))


@query("u3_set_difference", "select distinct o_custkey as k, 'only_f' as side from orders where o_orderstatus = 'F' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P') union all select distinct o_custkey, 'both' from orders where o_orderstatus = 'F' and o_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def _(p):
    o = p.table("orders")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    q = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return f.join(q, "k", "left_anti").withColumn("side", F.lit("only_f")).unionByName(f.join(q, "k", "left_semi").withColumn("side", F.lit("both")))


@query("u4_missing_months", with_views(", g as (select symbol, last_day(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), interval 1 month))::date) as date from px_month group by symbol)\nselect symbol, date from g where (symbol, date) not in (select symbol, date from px_month)", "px_month"))
def _(p):
    span = p.px_month.groupBy("symbol").agg(F.trunc(F.min("date"), "month").alias("a"), F.trunc(F.max("date"), "month").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select("symbol", F.last_day("m").alias("date"))
    return grid.join(p.px_month, ["symbol", "date"], "left_anti")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("u5_pivot", with_views("select date, " + ", ".join(f"round(max(case when symbol = '{x}' then close end) + 1e-6, 4) as p{x[0]}" for x in _PRIORITIES) + " from px_day group by date", "px_day"))
def _(p):
    wide = p.px_day.groupBy("date").pivot("symbol", _PRIORITIES).agg(F.first("close"))
    return wide.select("date", *[rounded(F.col(f"`{x}`"), 4).alias(f"p{x[0]}") for x in _PRIORITIES])


@query("u6_melt", with_views("select symbol, date, variable, round(value + 1e-6, 4) as value from facts", "facts"))
def _(p):
    return p.metrics.unpivot(["symbol", "date"], ["discount", "tax", "quantity", "price"], "variable", "value").withColumn("value", rounded("value", 4))


@query("u7_merge_newest", with_views("select date, round(coalesce(n.bench * 2, o.bench) + 1e-6, 4) as bench from (select * from bench_day where date < date '1999-01-01') o full join (select * from bench_day where date >= date '1998-06-01') n using (date)", "bench_day"))
def _(p):
    old = p.bench_day.where("date < date'1999-01-01'")
    new = p.bench_day.where("date >= date'1998-06-01'").select("date", (F.col("bench") * 2).alias("bench"), F.lit(1).cast("long").alias("seq"))
    return tb.upsert(old, new, ["date"]).withColumn("bench", rounded("bench", 4))


@query("u8_resample_week", with_views(", x as (select symbol, date + cast(((7 - isodow(date)) % 7) as integer) as week, date, close from px_day)\nselect symbol, week, round(max_by(close, date) + 1e-6, 4) as close from x group by 1, 2", "px_day"))
def _(p):
    """Last value of each week, labelled by its Sunday."""
    sunday = F.date_add("date", 6 - F.weekday("date"))
    return p.px_day.groupBy("symbol", sunday.alias("week")).agg(rounded(F.max_by("close", "date"), 4).alias("close"))




@query("k7_append_json", "select r_regionkey::bigint as k, r_name as name from region union all select n_nationkey::bigint, n_name from nation")
def _(p):
    path = tb.work_dir(p.spark, "append")
    tb.append_json(p.table("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path)
    tb.append_json(p.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), path)
    return p.spark.read.schema("k long, name string").json(path)


@query("k9_portfolio_files", "select s_suppkey || ': sector ' || r_name || ', score ' || (s_suppkey % 10) || '.50' as value from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(p):
    path = tb.work_dir(p.spark, "portfolio")
    tb.write_portfolio(p.sectors.withColumn("score", F.col("symbol") % 10 + 0.5), path)
    return p.spark.read.text(f"{path}/rationale")


@query("s11_melt_weights", "select symbol, date, round(weight + 1e-10, 8) as weight from (select p_partkey as symbol, date '2024-01-31' as date, p_size / 100.0 as weight from part union all select p_partkey, date '2024-02-29', p_retailprice / 100 from part where p_size % 2 = 0)")
def _(p):
    wide = p.table("part").select("p_partkey", F.col("p_size").cast("double").alias("2024-01-31"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("2024-02-29"))
    return tb.melt_weights(wide, "p_partkey").withColumn("weight", rounded("weight", 8))


@query("t5_pending_work", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 2)")
def _(p):
    done = p.table("lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.pending(p.table("orders").select("o_orderkey"), done, ["o_orderkey"])
