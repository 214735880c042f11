"""Connected components of links that never leave the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from boxquery.session import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of the component of each linked node that is not itself the smallest.

    Two star steps per round: every node hands its larger, then its smaller neighbours to the smallest one it
    knows. Rounds grow with the logarithm of the longest path. Each is written to the scratch folder. Minima are
    taken before the shuffle and hubs are only joined, so a hub is split like any hot join key.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, state = written(edges, "components"), None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state or seen["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")


class Union:
    """Sets of the numbers 0 to n-1; the smallest of a set stands for it."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        root = self.parent[of]
        while (self.parent[root] != root).any():
            root = self.parent[root]
        self.parent[of] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
