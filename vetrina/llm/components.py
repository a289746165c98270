"""Connected components of an edge table, as Spark jobs.

Alternating star rounds: each round points every node's neighbours at their
smallest neighbour, first the larger ones, then the smaller ones. Only two
numbers a round (edge count and checksum) reach the driver. A hub with many
edges costs partial aggregates and a join that AQE may split, never a list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.session import cut_lineage

EDGE = "a long, b long"


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node of each component."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            return parent
        a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its component's smallest one, of these edges alone."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = smallest_labels(len(nodes), at[:len(a)], at[len(a):])
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(batches):
    for batch in batches:
        node, root = star_edges(batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": node, "b": root})


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    return (large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionAll(small.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges(a, b)`` of longs;
    root is the smallest node reachable. Loops and repeated edges are fine, a
    node without edges to others doesn't appear, no edges give no rows."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(now.mapInPandas(_contract, EDGE).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or (seen[0], seen[1]) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = (seen[0], seen[1])
        now = cut_lineage(_round(now), "edges")
