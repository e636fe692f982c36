"""Connected components of a distributed edge list.

Alternating large-star and small-star steps: every step rewires edges towards smaller nodes, and the
number of rounds grows with the logarithm of the graph's size. Each step is a minimum per node (reduced
before the shuffle) and an equality join that adaptive execution can split on hot nodes; nothing is
gathered per node and nothing reaches the driver but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.storage import write_once


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(smallest, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node that an edge ``u, v`` names.

    Self-loops and repeated edges are harmless, edges with a null end are ignored, and an empty table
    gives an empty table. Each round is written to shared storage, so that a lost executor costs one round.
    """
    found = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found, before = write_once(found, "edges"), None
    now = _state(found)
    while now[0] and now != before:
        found = write_once(_small_star(_large_star(found)).distinct(), "edges")
        before, now = now, _state(found)
    parts = found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return parts.unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merge_links(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``parent`` (for each position the smallest of its group) after the links left[i] - right[i] have joined groups."""
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent
