"""Connected components by alternating large-star and small-star operations on an edge table.

A table of at most at_once edges is small enough for the driver, whose one pass replaces all rounds; the bound is on edges, so
what reaches the driver doesn't grow with the input, and larger tables take the rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node among the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges run from the larger to the smaller node."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels): every root that has a smaller neighbour is hung under the least one, until the ends of all edges agree."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while (top[x] != top[y]).any():
        a, b = top[x], top[y]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
    return nodes, nodes[top]


def components(edges: DataFrame, max_rounds: int = 50, at_once: int = 1 << 18, stored: bool = False) -> DataFrame:
    """(node, label) of every node that has an edge (u, v); label is the least node of its component.

    Neighbourhoods are never gathered: each operation is one aggregate and one equi-join, which adaptive execution splits
    where a node has very many neighbours. Every round is written to the shared folder. Null nodes and loops are ignored.
    stored: the edges are read from stored tables, and are not written once more.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = edges if stored else materialise(edges, "edges")
    if edges.count() <= at_once:
        few = edges.toArrow()
        nodes, labels = least_labels(few["u"].to_numpy(), few["v"].to_numpy())
        return materialise(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "label": labels}), "node long, label long"), "components")
    for _ in range(max_rounds):
        moved = materialise(small_star(large_star(edges)), "edges")
        change = edges.select("u", "v", F.lit(1).alias("d")).union(moved.select("u", "v", F.lit(-1).alias("d")))
        total = change.agg(F.sum("d").alias("n"), F.sum(F.col("d") * F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        edges = moved
        if not total["n"] and not total["h"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
    return materialise(out, "components")  # a stored table: an aggregate in the stage of a join would keep a hot label whole
