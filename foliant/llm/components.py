"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


class Forest:
    """Classes over 0..n-1; a batch of links costs a few array operations, whatever the number of classes they join."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The smallest index of the class of each of x."""
        top = self.parent[x]
        while not np.array_equal(up := self.parent[top], top):
            top = up
        self.parent[x] = top
        return top

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.find(x), self.find(y)
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            # a root is hung below the smallest root that it is linked to; links that this leaves apart go round again
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def stars(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(member, smallest member) of every class of two or more, but for the smallest itself. nodes: by index."""
        label = self.find(np.arange(len(nodes)))
        least = np.full(len(nodes), np.iinfo("int64").max)
        np.minimum.at(least, label, nodes)
        top = least[label]
        return nodes[nodes != top], top[nodes != top]


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its class) of every node of links (u, v; long).

    Alternating large-star and small-star steps: each points a node's neighbours at the smallest of them, until
    nothing changes; the number of rounds grows with the logarithm of the longest path. Every step is an aggregation
    (combined before the shuffle) and a join whose hot side adaptive execution splits, and is written, so no lineage
    grows and a lost executor costs one step.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
        # large star: larger neighbours of a node point at the smallest of its neighbourhood
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours point at the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("low")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        edges = written(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "small-star")
        # order-independent, so a change of plan or partitioning can't be mistaken for a change of links
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
