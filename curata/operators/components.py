"""Connected components by alternating large and small stars.

``star_components`` takes links between nodes. A large star ties every larger neighbour of
a node to the smallest node it sees; a small star ties the smaller ones (Kiveris, Lattanzi,
Mirrokni, Rastogi, Vassilvitskii, "Connected components in MapReduce and beyond", 2014).
Before each round every task contracts its own links, ``TASK_LINKS`` at most on average, to
stars by union-find, so a component within one task needs no round at all. The rounds grow
with the logarithm of the component, not with its diameter. A round is partial aggregations
and equi-joins (AQE splits the partition of a hub), and is written to the shared checkpoint
folder, so a lost executor costs one round at most.

``connected_components`` links rows by shared keys: each key ties its rows to its smallest
row, a partial aggregation, and rows that share no key with another never enter the rounds.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.session import ensure_checkpoint_dir, ship_package

TASK_LINKS = 1 << 16


def _state(edges: DataFrame) -> tuple:
    """Number and order-independent digest of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _contracted(edges: DataFrame, count: int) -> DataFrame:
    """The links of each task as stars around the smallest node of each of its components."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        parent: dict = {}

        def root(x):
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch["u"], batch["v"]):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        nodes = list(parent)
        yield pd.DataFrame({"u": nodes, "v": [root(x) for x in nodes]})

    return edges.coalesce(max(1, -(-count // TASK_LINKS))).mapInPandas(run, f"u {kind}, v {kind}")


def star_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node in ``links`` (columns ``a`` and ``b``); the root is the
    component's smallest node. Nodes without a link to another node are left out."""
    ensure_checkpoint_dir(links.sparkSession)
    ship_package(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").checkpoint()
    edges = _contracted(edges, edges.count()).checkpoint()
    before = _state(edges)
    while edges.rdd.getNumPartitions() > 1:  # one task's links are whole components already
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = _state(edges)
        if after == before:
            break
        before = after
        edges = _contracted(edges, after[0]).checkpoint()
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def connected_components(rows: DataFrame, id_col: str, key_cols: list[str]) -> DataFrame:
    """rows: (id, key1, key2, ...) with NULL keys linking nothing.
    Returns (id, component) where component = min id of the component."""
    def tied(key: str) -> DataFrame:
        keyed = rows.where(F.col(key).isNotNull()).select(F.col(id_col).alias("a"), F.col(key).alias("k"))
        first = keyed.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
        return keyed.join(first, "k").where("a <> b").select("a", "b")

    roots = star_components(reduce(DataFrame.unionByName, map(tied, key_cols)), "a", "b")
    ids = rows.select(F.col(id_col).alias("node")).distinct()
    return ids.join(roots, "node", "left").select(
        F.col("node").alias(id_col), F.coalesce("root", "node").alias("component"))
