"""Connected components by alternating large-star and small-star steps over written tables, or at once where the graph
is small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that the driver solves by itself, 4 MB; the rounds of more run as tables. Both find the same labels.
FEW = 1 << 18


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One star step; edges have columns u > v. The minima are written first, so that the join reads two plain
    tables and adaptive execution can split a hub's rows."""
    if large:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sym = edges
    mins = scratch.keep(sym.groupBy("u").agg(F.min("v").alias("m")))
    joined = sym.join(mins.withColumnRenamed("u", "mu"), F.col("u") == F.col("mu"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
    return scratch.keep(out.where("u <> v").distinct())


def _solved(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        for x in (label[a], label[b]):  # roots point to the least root next to them
            np.minimum.at(label, x, low)
        while (label != (up := label[label])).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u, v) of long ids -> (node, label): label is the smallest id of the component. Nodes without an edge
    are absent. Ends when a round changes nothing; the number of rounds grows with the logarithm of the diameter. Up to FEW
    edges take no rounds."""
    now = scratch.keep(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    if now.count() <= FEW:
        t = now.toArrow()
        node, label = _solved(t.column("u").to_numpy(), t.column("v").to_numpy())
        scratch.drop(now)
        return scratch.keep(now.sparkSession.createDataFrame(pa.table({"node": node, "label": label})))

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        mid = _star(now, scratch, large=True)
        new = _star(mid, scratch, large=False)
        after = state(new)
        scratch.drop(mid)
        scratch.drop(now)
        now = new
        if after == before:
            break
        before = after
    # at the fixed point every edge points from a node to its component's smallest id
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
