"""Portfolio construction: sector counts by largest remainder, score weights, equal weights, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div


def sector_counts(stocks: DataFrame, benchmark: DataFrame, target: int) -> DataFrame:
    """(sector, weight, available, n): target x weight over sectors with stocks, rounded by largest remainder (ties to
    the first name), then at least 1 and at most what is available. One row per sector, so the windows over all rows
    span a handful of rows."""
    have = stocks.groupBy("sector").agg(F.count("*").alias("available"))
    d = benchmark.join(have, "sector").withColumn("raw", target * F.col("weight"))
    d = d.withColumn("base", F.floor("raw")).withColumn("rest", F.col("raw") - F.col("base"))
    whole = Window.partitionBy(F.lit(1))
    d = d.withColumn("short", F.round(F.sum("raw").over(whole)) - F.sum("base").over(whole))
    place = F.row_number().over(whole.orderBy(F.desc("rest"), "sector"))
    n = F.col("base") + F.when(place <= F.col("short"), 1).otherwise(0)
    return d.select("sector", "weight", "available", F.greatest(F.lit(1), F.least(n, F.col("available"))).cast("int").alias("n"))


def build(stocks: DataFrame, benchmark: DataFrame, target: int) -> DataFrame:
    """stocks(symbol, sector, score) -> (symbol, sector, score, weight): the best of each sector, weighted by score within
    the sector's weight (equally if all scores are zero), the whole brought to 1."""
    counts = sector_counts(stocks, benchmark, target)
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("score"), "symbol"))
    picked = stocks.withColumn("place", place).join(F.broadcast(counts), "sector").where(F.col("place") <= F.col("n"))
    total = F.sum("score").over(Window.partitionBy("sector"))
    k = F.count("*").over(Window.partitionBy("sector"))
    raw = F.when(total > 0, F.col("score") / F.nullif(total, F.lit(0.0)) * F.col("weight")).otherwise(F.col("weight") / k)
    picked = picked.withColumn("raw", raw)
    whole = picked.agg(F.sum("raw").alias("whole"))
    return picked.join(F.broadcast(whole)).select("symbol", "sector", "score", F.coalesce(safe_div("raw", "whole"), F.col("raw")).alias("weight"))


def allocations(holdings: DataFrame, benchmark: DataFrame) -> DataFrame:
    g = holdings.groupBy("sector").agg(F.sum("weight").alias("actual"), F.count("*").alias("n"))
    return g.join(F.broadcast(benchmark.select("sector", F.col("weight").alias("benchmark"))), "sector", "left").select("sector", F.coalesce("benchmark", F.lit(0.0)).alias("benchmark"), "actual", "n")


def equal_weight(stocks: DataFrame, threshold: float) -> DataFrame:
    """Equal weights of the stocks strictly above a score."""
    picked = stocks.where(F.col("score") > threshold)
    n = picked.agg(F.count("*").alias("n"))
    return picked.join(F.broadcast(n)).select("symbol", "sector", "score", (1.0 / F.col("n")).alias("weight"))


def normalised(df: DataFrame, weight: str) -> DataFrame:
    """Weights over their sum."""
    total = df.agg(F.sum(weight).alias("__t"))
    return df.join(F.broadcast(total)).withColumn(weight, safe_div(weight, "__t")).drop("__t")


def drift(current: Column, target: Column, threshold: float = 0.05, tolerance: float = 1e-6) -> tuple[Column, Column, Column]:
    """(drift, percent, rebalance): percent of the target; without a target infinity of the drift's sign, or 0."""
    d = current - target
    pct = F.when(F.abs(target) > tolerance, d / F.nullif(target, F.lit(0.0)) * 100).when(d > 0, float("inf")).when(d < 0, float("-inf")).otherwise(0.0)
    return d, pct, F.abs(d) >= threshold


def universe(holdings: DataFrame) -> DataFrame:
    """(sector, weight, n): benchmark weights out of holdings."""
    total = holdings.agg(F.sum("value").alias("t"))
    g = holdings.groupBy("sector").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return g.join(F.broadcast(total)).select("sector", safe_div("v", "t").alias("weight"), "n")
