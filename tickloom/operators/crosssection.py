"""Cross-sectional operators: normalisation, ranks, quantile labels, composites, fills, double sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, bin_of, clip, percent_rank_average, probabilities, quantile_bins, safe_div

MAD_SCALE = 1.4826


def zscore(df: DataFrame, c: str, keys: list[str], out: str, robust: bool = True, least: int = 5) -> DataFrame:
    """df with the z-score by group: median and scaled median absolute deviation, or mean and sample deviation.
    Missing where the group has too few values or no spread, or lacks a key."""
    w = Window.partitionBy(*keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    if robust:
        d = df.withColumn("__m", F.median(c).over(w)).withColumn("__d", F.abs(F.col(c) - F.col("__m")))
        d = d.withColumn("__s", F.median("__d").over(w) * MAD_SCALE)
    else:
        d = df.withColumn("__m", F.avg(c).over(w)).withColumn("__s", F.stddev_samp(c).over(w)).withColumn("__d", F.lit(None))
    z = F.when(whole & (F.count(c).over(w) >= least) & (F.col("__s") > 0), (F.col(c) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))
    return d.withColumn(out, z).drop("__m", "__d", "__s")


def winsorise(c: Column | str, low: float, high: float, *keys: str, least: int = 1) -> Column:
    """Values clipped to their group's linear quantiles, where it has enough values; otherwise as they are."""
    c = as_col(c)
    w = Window.partitionBy(*keys)
    edges = F.percentile(c, F.array(F.lit(low), F.lit(1 - high))).over(w)
    return F.when(F.count(c).over(w) >= least, clip(c, edges[0], edges[1])).otherwise(c)


def rank_labels(b: Column, n: int = 5) -> Column:
    """rank1 (best) .. rankn from ascending bins."""
    return F.when(b.isNotNull(), F.concat(F.lit("rank"), (n + 1 - b).cast("string")))


def factor_metrics(df: DataFrame, c: str, keys: list[str], inverted: bool = False, least: int = 10) -> DataFrame:
    """df with pct_rank, quintile and z of the winsorised value, by date or date and sector; inverted: 1 - rank,
    mirrored quintile, negated z."""
    d = df.withColumn("__x", winsorise(c, 0.01, 0.01, *keys, least=least))
    d = d.withColumn("__p", percent_rank_average("__x", *keys)).withColumn("__q", quantile_bins("__x", 5, *keys))
    d = zscore(d, "__x", keys, "__z", robust=False, least=2)
    flip = {"pct_rank": 1 - F.col("__p"), "quintile": 6 - F.col("__q"), "z": -F.col("__z")}
    plain = {"pct_rank": F.col("__p"), "quintile": F.col("__q"), "z": F.col("__z")}
    return d.withColumns(flip if inverted else plain).drop("__x", "__p", "__q", "__z")


def transition_label(ranks: list[Column], high: list[str], low: list[str]) -> Column:
    """remain high / remain low / move to high / drop to low / others; any missing rank makes it missing."""
    missing, all_high, all_low = F.lit(False), F.lit(True), F.lit(True)
    for r in ranks:
        missing, all_high, all_low = missing | r.isNull(), all_high & r.isin(high), all_low & r.isin(low)
    first, last = ranks[0], ranks[-1]
    return (
        F.when(missing, None).when(all_high, "remain high").when(all_low, "remain low")
        .when(~first.isin(high) & last.isin(high), "move to high").when(~first.isin(low) & last.isin(low), "drop to low").otherwise("others")
    )


def transitions(df: DataFrame, now: str, following: str) -> DataFrame:
    return df.where(F.col(now).isNotNull() & F.col(following).isNotNull()).groupBy(now, following).agg(F.count("*").alias("n"))


def sector_scores(df: DataFrame, c: str) -> DataFrame:
    """z by (date, sector) and the rank in it, best first, ties sharing the smallest rank."""
    d = zscore(df, c, ["date", "sector"], "z", robust=True, least=2)
    return d.withColumn("sector_rank", F.rank().over(Window.partitionBy("date", "sector").orderBy(F.desc_nulls_last(c))).cast("int"))


def extremes(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """(side, place, name, value): the n best, and the n worst from the worst on; the lists may overlap. Two sorts with a
    limit, so nothing is ranked as a whole."""
    d = df.where(F.col(value).isNotNull()).select(F.col(name).alias("name"), F.col(value).alias("value"))
    top = d.orderBy(F.desc("value"), "name").limit(n).withColumn("side", F.lit("top"))
    bottom = d.orderBy("value", F.desc("name")).limit(n).withColumn("side", F.lit("bottom"))
    w = Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col("value")).otherwise(F.col("value")), F.when(F.col("side") == "top", F.col("name")), F.desc("name"))
    return top.unionByName(bottom).select("side", F.row_number().over(w).alias("place"), "name", "value")


def composite(df: DataFrame, weights: dict[str, tuple[float, bool]], keys: list[str], out: str = "score") -> DataFrame:
    """Weighted sum of robust z-scores by metric -> (weight, inverted); any missing metric makes it missing."""
    d, total = df, F.lit(0.0)
    for c, (weight, inverted) in weights.items():
        d = zscore(d, c, keys, f"__{c}", robust=True, least=1)
        total = total + (-1 if inverted else 1) * weight * F.col(f"__{c}")
    return d.withColumn(out, total).drop(*[f"__{c}" for c in weights])


def filled_by_median(c: str, date: str = "date", sector: str = "sector", last: float = 0.5) -> Column:
    """The value, else its sector's median that day, else the day's, else a constant."""
    return F.coalesce(F.col(c), F.median(c).over(Window.partitionBy(date, sector)), F.median(c).over(Window.partitionBy(date)), F.lit(last))


def active_return(df: DataFrame, bench: DataFrame, on: list[str], r: str = "r", b: str = "b") -> DataFrame:
    return df.join(bench, on, "left").withColumn("active", F.col(r) - F.col(b))


def acceleration(recent: Column, trend: Column, floor: Column | float, limit: float) -> tuple[Column, Column]:
    """(relative, absolute) gap of recent growth to trend growth: relative to the trend, at least `floor`, clipped to
    +/- limit; the absolute gap is not clipped."""
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    gap = recent - trend
    return clip(safe_div(gap, F.greatest(F.abs(trend), floor)), -limit, limit), gap


def smallest_scale(df: DataFrame, c: str, share: float = 0.05) -> DataFrame:
    """One row: the given quantile of the absolute values, as the floor of acceleration()."""
    return df.agg(F.percentile(F.abs(c), F.lit(share)).alias("floor"))


def rank_batch(facts: DataFrame) -> DataFrame:
    """(symbol, date, variable, pct_rank, quintile, z) of every variable in one job, partitioned by date and variable."""
    return factor_metrics(facts, "value", ["date", "variable"]).drop("value")


def double_sort(df: DataFrame, a: str, b: str, n: int, conditional: bool, key: str = "date") -> DataFrame:
    """df with bins bin_a and bin_b: the second within the date, or (conditional) within the first bin of the date."""
    d = df.withColumn("bin_a", quantile_bins(a, n, key))
    return d.withColumn("bin_b", quantile_bins(b, n, key, "bin_a") if conditional else quantile_bins(b, n, key))


def rank_persistence(df: DataFrame, c: str, n: int = 5) -> DataFrame:
    """Share of symbols that keep their bin on the next date, by bin."""
    d = df.withColumn("bin", quantile_bins(c, n, "date"))
    d = d.withColumn("following", F.lead("bin").over(Window.partitionBy("symbol").orderBy("date")))
    return d.where("bin is not null and following is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg((F.col("bin") == F.col("following")).cast("int")).alias("kept"))


def quantile_edges(df: DataFrame, c: str, n: int, keys: list[str]) -> DataFrame:
    """(keys, edges): for large groups, edges once per group, to be joined back for bin_of()."""
    return df.groupBy(*keys).agg(F.percentile(c, F.array(*[F.lit(p) for p in probabilities(n)])).alias("edges"))


def binned(df: DataFrame, c: str, n: int, keys: list[str], out: str = "bin", whole: bool = False) -> DataFrame:
    """bin_of() with edges joined back, one aggregate per group instead of one percentile per row."""
    return df.join(quantile_edges(df, c, n, keys), keys).withColumn(out, bin_of(c, F.col("edges"), n, whole)).drop("edges")
