"""Connected components of a graph of links, by alternating large and small stars.

A large star links each node's larger neighbours to its smallest one, a small star each node's
smaller neighbours and itself; repeated, every component becomes a star around its smallest node. All
steps are joins and minima over tables in the shared folder. Nothing about nodes reaches the driver
but a count and a checksum that tell when the links no longer change.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of links a-b, roots left out; a root is its smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(root, before):
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of every node that a link names, but for the smallest nodes.

    links: two columns of longs without nulls; direction, repetition and loops don't matter.
    """
    a, b = (F.col(c) for c in links.columns)
    now = scratch.write(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    last = None
    while True:
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = scratch.write(both.join(low, "x").where("y > x and y <> m").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo")))
        then = scratch.write(small.distinct())
        scratch.drop(now, large)
        now = then
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.min("hi"), F.max("lo")).first()
        if state == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        last = state
