"""Equi-joins of the panel kind: alignment, forward filling, lookup chains, anti-joins, similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by, filled


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join without rows that miss a value."""
    return a.join(b, on).dropna()


def outer_filled(a: DataFrame, b: DataFrame, on: str, *columns: str, how: str = "outer") -> DataFrame:
    """Join of two dated series, with gaps of either side taking the last value."""
    w = by(order=on)
    j = a.join(b, on, how)
    return j.select(on, *[filled(c, w).alias(c) for c in columns])


def weighted_left(weights: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join without rows that have no weight, which is a left join from the weights."""
    return weights.dropna(subset=["weight"]).join(values, on, "left")


def coalesced_lookup(df: DataFrame, lookups: list[tuple[DataFrame, str]], out: str) -> DataFrame:
    """Identifier by the first lookup that knows the row: each (lookup(key, out), key column) is left-joined."""
    names = []
    for i, (lookup, key) in enumerate(lookups):
        name = f"__found{i}"
        df = df.join(lookup.select(F.col(key), F.col(out).alias(name)), key, "left")
        names.append(name)
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def first_similar(items: DataFrame, existing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Per item the first existing item with the same link or a title of at least that word similarity.

    Titles are compared only where they share a word among the rarest ones of the item (prefix filter: at Jaccard t, two
    sets of n words share one of the n - ceil(t n) + 1 rarest), so no all-pairs join is made. Both have (item_id, link,
    title)."""

    def tokens(df: DataFrame) -> DataFrame:
        return df.withColumn("ws", F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda t: t != "")))

    a, b = tokens(items), tokens(existing)
    freq = a.select(F.explode("ws").alias("t")).unionByName(b.select(F.explode("ws").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(F.col("item_id").alias(name), F.size("ws").alias("n"), F.explode("ws").alias("t")).join(freq, "t")
        per = ranked.groupBy(name, "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
        keep = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
        return per.select(name, F.explode(F.transform(F.slice("o", 1, keep), lambda x: x["t"])).alias("t"))

    pairs = prefixes(a, "x").join(prefixes(b, "y"), "t").select("x", "y").distinct()
    left = a.select(F.col("item_id").alias("x"), F.col("ws").alias("wx"))
    right = b.select(F.col("item_id").alias("y"), F.col("ws").alias("wy"))
    similar = pairs.join(left, "x").join(right, "y")
    jaccard = F.size(F.array_intersect("wx", "wy")) / F.size(F.array_union("wx", "wy"))
    similar = similar.where(jaccard >= threshold).select("x", "y")
    same = a.select(F.col("item_id").alias("x"), "link").join(b.select(F.col("item_id").alias("y"), "link"), "link").select("x", "y")
    return similar.unionByName(same).groupBy("x").agg(F.min("y").alias("first")).withColumnRenamed("x", "item_id")
