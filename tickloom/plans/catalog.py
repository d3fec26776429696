"""All registered queries, by operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import by, rounded
from ..operators import crosssection as cx
from ..operators import indicators as ind
from ..sources.panels import Panels, with_views
from . import aggregates, factors, feeds, tables, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly prices -> three-month return and moving average per symbol -> robust z-score per date."""
    w = by("symbol", order="date")
    panel = Panels(spark, folder).px_month
    d = panel.select("symbol", "date", ind.simple_return("close", w, 3).alias("ret_3m"), ind.sma("close", w, 3).alias("sma_3"))
    z = cx.zscore(d.where("ret_3m is not null"), "ret_3m", ["date"], "z")
    return z.where("z is not null").select("symbol", "date", rounded("ret_3m").alias("ret_3m"), rounded("sma_3", 4).alias("sma_3"), rounded("z", 5).alias("z"))


@query(
    "flagship",
    with_views(
        """a as (select symbol, date, close / nullif(lag(close, 3) over w, 0) - 1 as r, case when count(close) over w3 >= 3 then avg(close) over w3 end as s from px_month
  window w as (partition by symbol order by date), w3 as (partition by symbol order by date rows between 2 preceding and current row)),
b as (select *, median(r) over (partition by date) as m, count(r) over (partition by date) as n from a where r is not null),
c as (select *, 1.4826 * median(abs(r - m)) over (partition by date) as d from b)
select symbol, date, round(r + 1e-8, 6) as ret_3m, round(s + 1e-6, 4) as sma_3, round((r - m) / d + 1e-7, 5) as z from c where n >= 5 and d > 0""",
        "px_month",
    ),
)
def _(p):
    return flagship(p.spark, p.folder)
