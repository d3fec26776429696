"""Null-safe arithmetic, positional windows and pandas-compatible statistics as columns.

Missing is NULL throughout: NaN is turned into NULL at ingest and never emitted; division goes through nullif because
ANSI division by zero raises.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def finite(c: Column | str) -> Column:
    """Infinite values become missing."""
    c = as_col(c)
    return F.when(F.abs(c) == float("inf"), None).otherwise(c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    return as_col(a) / F.nullif(as_col(b), F.lit(0.0))


def rounded(c: Column | str, k: int = 6) -> Column:
    """Half-up at k places, nudged off exact halves so that engines that scale differently agree."""
    return F.round(as_col(c) + F.lit(10.0 ** -(k + 2)), k)


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Values limited to [low, high]; a missing value stays missing (greatest and least skip NULL by themselves)."""
    c = as_col(c)
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def by(*keys: str, order: str | None = None) -> WindowSpec:
    w = Window.partitionBy(*keys)
    return w.orderBy(order) if order else w


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return w.rowsBetween(-(n - 1), 0)


def rolling(agg: Column, of: Column | str, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg over the last n rows where at least `least` (default n) values are not missing."""
    frame = trailing(w, n)
    return F.when(F.count(as_col(of)).over(frame) >= (n if least is None else least), agg.over(frame))


def filled(c: Column | str, w: WindowSpec) -> Column:
    """The last value that is not missing."""
    return F.last(as_col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def change(c: Column | str, n: int, w: WindowSpec) -> Column:
    """Value over the value n rows earlier, minus one; gaps are not padded."""
    c = as_col(c)
    return safe_div(c, F.lag(c, n).over(w)) - 1


def skewness(c: Column | str) -> Column:
    """Bias-corrected sample skewness, missing below three values or without spread."""
    c = as_col(c)
    n = F.count(c)
    return F.when((n >= 3) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurtosis(c: Column | str) -> Column:
    """Bias-corrected sample excess kurtosis, missing below four values or without spread."""
    c = as_col(c)
    n = F.count(c)
    return F.when((n >= 4) & (F.var_pop(c) > 0), ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def percent_rank_average(c: Column | str, *keys: str) -> Column:
    """Average-tie rank over the count of values, by group; missing stays missing."""
    c = as_col(c)
    w = Window.partitionBy(*keys)
    ties = F.count(c).over(Window.partitionBy(*keys, c))
    return F.when(c.isNotNull(), (F.rank().over(w.orderBy(c.asc_nulls_last())) + (ties - 1) / 2) / F.count(c).over(w))


def average_rank(c: Column | str, *keys: str) -> Column:
    c = as_col(c)
    ties = F.count(c).over(Window.partitionBy(*keys, c))
    return F.when(c.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(c.asc_nulls_last())) + (ties - 1) / 2)


def probabilities(n: int) -> list[float]:
    """The n + 1 equally spaced probabilities in their floating-point form (0.6000000000000001, not 0.6)."""
    return [float(x) for x in np.linspace(0, 1, n + 1)]


def bin_of(c: Column | str, edges: Column, n: int, whole: bool = False) -> Column:
    """Right-closed quantile bin (1-based) of a value among the group's n + 1 linear quantile edges. Equal edges are
    merged and bins renumbered; with whole=True a group with any equal edges has no bins at all. A value that equals an
    edge but for the last bits of the interpolation counts as equal to it."""
    c = as_col(c)
    distinct = F.array_distinct(edges)
    inner = F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0)))
    bins = F.lit(1) + F.size(F.filter(inner, lambda e: e < c - F.abs(c) * 1e-12))
    enough = F.size(distinct) == n + 1 if whole else F.size(distinct) >= 2
    return F.when(c.isNotNull() & enough, bins.cast("int"))


def quantile_bins(c: Column | str, n: int, *keys: str, whole: bool = False) -> Column:
    """bin_of() with the edges of the row's own group."""
    edges = F.percentile(as_col(c), F.array(*[F.lit(p) for p in probabilities(n)])).over(Window.partitionBy(*keys))
    return bin_of(c, edges, n, whole)
