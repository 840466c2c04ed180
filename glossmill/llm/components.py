"""Connected components of a graph given as edges: alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest vertex of its component under edges a[i]-b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v), u > v: each vertex ties its larger (or its smaller) neighbours to its smallest one.

    The smallest neighbour comes from a minimum that is aggregated before the shuffle. It is materialised, so that both sides of
    the join are plain exchanges: Spark then splits a hub's edges over several tasks (adaptive skew joins).
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        made = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> vertex, root (the smallest vertex of its component); vertices without an edge are not returned."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    state = None
    while True:  # a round shortens every path; the number of rounds is about the logarithm of the longest one
        now = cut(_star(cut(_star(now, True)), False))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
