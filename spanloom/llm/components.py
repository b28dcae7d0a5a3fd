"""Connected components of a link table by rounds of joins, without gathering any component in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common as c


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``links``: the smallest id reachable.

    Alternates two steps until nothing changes: each node hooks its larger neighbours to its smallest neighbour, and
    each node hooks its smaller neighbours to it. A node with many neighbours is aggregated partially and joined as
    a skewed side, never collected. The number of rounds grows with the logarithm of the longest path.
    Edges are written to the shared folder in every round.
    """
    edges = c.staged(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = c.staged(small, "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        c.drop_staged(edges)
        edges = after
        if now == before:
            break
        before = now
    stars = edges.unionAll(edges.select(F.col("v").alias("u"), "v"))
    return stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    root: dict[int, int] = {}
    keep = []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]
