"""Panels from the base tables: prices, benchmarks, sectors, fundamentals, feed items.

Prices are exact decimal sums over counts, unrounded, so that they are the same in any order of summation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exact(c: str, scale: int = 2):
    return F.sum(F.col(c).cast(f"decimal(18,{scale})")).cast("double")


class Panels:
    """Lazy views over one folder of base tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def px_month(self) -> DataFrame:
        """(symbol, date, close): supplier by ship month."""
        d = F.last_day(F.col("l_shipdate").cast("date"))
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol"), d.alias("date")).agg((_exact("l_extendedprice") / F.sum("l_quantity")).alias("close"))

    @cached_property
    def px_day(self) -> DataFrame:
        """(symbol, date, close): order priority by day."""
        return self.table("orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).agg((_exact("o_totalprice") / F.count("*")).alias("close"))

    @cached_property
    def bench_month(self) -> DataFrame:
        d = F.last_day(F.col("l_shipdate").cast("date"))
        return self.table("lineitem").groupBy(d.alias("date")).agg((_exact("l_extendedprice") / F.sum("l_quantity")).alias("bench"))

    @cached_property
    def bench_day(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((_exact("o_totalprice") / F.count("*")).alias("bench"))

    @cached_property
    def sectors(self) -> DataFrame:
        """(symbol, sector): supplier by region; the lookup tables are a few rows."""
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        joined = self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"))

    @cached_property
    def metrics(self) -> DataFrame:
        """(symbol, date, discount, tax, quantity, price): wide fundamentals by supplier-month."""
        d = F.last_day(F.col("l_shipdate").cast("date"))
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol"), d.alias("date")).agg(
            (_exact("l_discount", 4) / F.count("*")).alias("discount"),
            (_exact("l_tax", 4) / F.count("*")).alias("tax"),
            F.sum("l_quantity").alias("quantity"),
            _exact("l_extendedprice").alias("price"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """(symbol, date, variable, value): the long form of metrics."""
        return self.metrics.unpivot(["symbol", "date"], ["discount", "tax", "quantity", "price"], "variable", "value")

    @cached_property
    def items(self) -> DataFrame:
        """(item_id, link, title): feed items from the pages."""
        title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
        return self.table("pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("link"), title.alias("title"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "px_month": """px_month as (select l_suppkey as symbol, last_day(cast(l_shipdate as date)) as date,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(l_quantity) as close from lineitem group by 1, 2)""",
    "px_day": """px_day as (select o_orderpriority as symbol, cast(o_orderdate as date) as date,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as close from orders group by 1, 2)""",
    "bench_month": """bench_month as (select last_day(cast(l_shipdate as date)) as date,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(l_quantity) as bench from lineitem group by 1)""",
    "bench_day": """bench_day as (select cast(o_orderdate as date) as date,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as bench from orders group by 1)""",
    "sectors": """sectors as (select s_suppkey as symbol, r_name as sector from supplier
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "metrics": """metrics as (select l_suppkey as symbol, last_day(cast(l_shipdate as date)) as date,
  cast(sum(cast(l_discount as decimal(18,4))) as double) / count(*) as discount,
  cast(sum(cast(l_tax as decimal(18,4))) as double) / count(*) as tax,
  sum(l_quantity) as quantity, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price
  from lineitem group by 1, 2)""",
    "facts": """facts as (select symbol, date, 'discount' as variable, discount as value from metrics
  union all select symbol, date, 'tax', tax from metrics union all select symbol, date, 'quantity', quantity from metrics
  union all select symbol, date, 'price', price from metrics)""",
    "items": """items as (select page_id as item_id, url as link, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)""",
    "ret_month": """ret_month as (select symbol, date, close, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as r from px_month)""",
    "ret_day": """ret_day as (select symbol, date, close, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as r from px_day)""",
    "bret_day": """bret_day as (select date, bench, bench / nullif(lag(bench) over (order by date), 0) - 1 as b from bench_day)""",
    "bret_month": """bret_month as (select date, bench, bench / nullif(lag(bench) over (order by date), 0) - 1 as b from bench_month)""",
}
_NEEDS = {"facts": ["metrics"], "ret_month": ["px_month"], "ret_day": ["px_day"], "bret_day": ["bench_day"], "bret_month": ["bench_month"]}


def with_views(body: str, *names: str) -> str:
    """body with the named views (and those they need) in front; body is a select, or further table expressions
    (`name as (...), ...`) and a select."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    body = body.strip().removeprefix(",").strip()
    more = "" if body.startswith("select") else ","
    return "with " + ",\n".join(SQL[n] for n in order) + f"{more}\n{body}"
