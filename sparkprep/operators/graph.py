"""Connected components of an edge list, by rounds of joins.

Alternating large and small stars: every round points each node to the least
node among its neighbours. Each round is written to the shared folder; the
number of rounds grows with the logarithm of the component size. Nothing but two
numbers per round reaches the driver, or a graph of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package

FEW = 20_000  # edges that the driver may take


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, and what tells them from others: both from one job."""
    seen = Observation()
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    edges = materialize(edges.observe(seen, *digest), "graph-edges")
    return edges, (seen.get["n"], seen.get["h"])


def _followed(edges: DataFrame) -> DataFrame:
    """Components of a bounded number of edges, on the driver."""
    root: dict = {}

    def top(n):
        while (up := root.get(n, n)) != n:
            root[n] = root.get(up, up)
            n = up
        return n

    taken = edges.select("u", "v").toArrow()
    for u, v in zip(*(c.to_pylist() for c in taken.columns), strict=True):
        a, b = sorted((top(u), top(v)))
        root[b] = a
    named = [(n, r) for n in list(root) if (r := top(n)) != n]
    # an Arrow table: rows of a list would be copied by Python workers on the executors, apart from those of mapInArrow
    arrow = pa.table([pa.array([row[i] for row in named], taken.schema.field(i).type) for i in range(2)], names=["node", "root"])
    kinds = edges.schema
    return edges.sparkSession.createDataFrame(arrow, T.StructType([T.StructField("node", kinds["u"].dataType), T.StructField("root", kinds["v"].dataType)]))


def _rooted(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """The least node of each node's component, nodes being 0, 1, ..: every root is hung on its least
    neighbour, paths are shortened and links moved up to the roots until none is left."""
    up = np.arange(nodes)
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (up != up[up]).any():
            up = up[up]
        u, v = up[u], up[v]
        u, v = u[u != v], v[u != v]
    return up


def _followed_by_task(edges: DataFrame) -> DataFrame:
    """Components of a bounded number of edges, in one task."""
    ship_package(edges.sparkSession)

    def rooted(pdf: pd.DataFrame) -> pd.DataFrame:
        both, nodes = pd.factorize(pd.concat([pdf["u"], pdf["v"]], ignore_index=True), sort=True)
        up = _rooted(both[:len(pdf)], both[len(pdf):], len(nodes))
        below = up != np.arange(len(up))
        return pd.DataFrame({"node": nodes[below], "root": nodes[up[below]]})

    kinds = edges.schema
    out = edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(rooted, T.StructType([T.StructField("node", kinds["u"].dataType), T.StructField("root", kinds["v"].dataType)]))
    return materialize(out, "graph-roots")


def connected_components(edges: DataFrame, few: int = FEW, one_task: int = 0) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots themselves;
    a root is the least node of its component. Loops and repeated edges count for nothing.
    At most ``few`` edges are followed on the driver, at most ``one_task`` by one task: rounds would cost more than the work."""
    edges, last = _kept(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if last[0] <= few:
        return _followed(edges)
    if last[0] <= one_task:
        return _followed_by_task(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges, now = _kept(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
                      .filter("u != v").distinct())
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
