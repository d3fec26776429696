"""Date helpers; 'today' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(d: Column | str) -> Column:
    return F.col(d) if isinstance(d, str) else d


def previous_tuesday(d: Column | str) -> Column:
    """The date itself if it is a Tuesday, else the last one before."""
    d = _col(d)
    return F.date_sub(d, F.pmod(F.weekday(d) - 1, F.lit(7)).cast("int"))


def last_tuesday(d: Column | str) -> Column:
    return F.date_sub(previous_tuesday(d), 7)


def weekly_period(d: Column | str) -> tuple[Column, Column, Column]:
    """Start, end and report date: Tuesday to Tuesday, reported on Wednesday."""
    end = previous_tuesday(d)
    return F.date_sub(end, 7), end, F.date_add(end, 1)


def weekdays_between(a: Column | str, b: Column | str) -> Column:
    """How many Mondays to Fridays lie in [a, b]."""
    a, b = _col(a), _col(b)
    days = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def parse(text: Column | str) -> Column:
    """2024-01-31, 20240131 or 01/31/2024; anything else is missing."""
    t = _col(text)
    forms = (("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), ("yyyyMMdd", r"^\d{8}$", "yyyyMMdd"), ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for _, p, f in forms])


def japanese(d: Column | str) -> Column:
    d = _col(d)
    day = F.get(F.array(*[F.lit(x) for x in "月火水木金土日"]), F.weekday(d))
    return F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日("), day, F.lit(")"))


def american(d: Column | str) -> Column:
    return F.date_format(_col(d), "MM/dd/yyyy")


def preset_start(as_of: Column | str, preset: str) -> Column:
    """1y, 3y, 5y, 10y, ytd, or max (30 years)."""
    d = _col(as_of)
    if preset == "ytd":
        return F.trunc(d, "year")
    years = {"1y": 1, "3y": 3, "5y": 5, "10y": 10, "max": 30}
    return F.add_months(d, -12 * years[preset])
