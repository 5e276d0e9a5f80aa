"""Connected components of a link table: of few links on the driver, of more by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most links (two longs each) that the driver takes. A round in Spark has several shuffles, and each of them has a thread of
#: the driver for a minute, with memory of its own; on few links that costs the driver more than the links do.
FEW = 200_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked nodes in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots go to smaller roots only, so no circle is made
        while not np.array_equal(higher := root[root], root):
            root = higher


def _neighbours(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("u <> v")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For links (u, v) of longs: each linked node with the smallest node it reaches (columns node, root).

    The driver joins up to ``FEW`` links by itself. With more, each round attaches larger neighbours to a node's smallest
    neighbour (large star), then smaller ones (small star); sums are made on the map side and the links are written to the
    shared folder, which cuts the lineage. The rounds end when the links no longer change, which is checked by their number
    and a hash of all of them.
    """
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if edges.count() <= FEW:
        got = edges.toArrow()
        node, root = least_reached(got["u"].to_numpy(), got["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}))
    seen = None
    for _ in range(most_rounds):
        near = _neighbours(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.filter("u <> v").distinct(), "links")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
