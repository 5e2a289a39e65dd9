"""Connected components of links between rows, by rounds of joins on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lectern.llm.spark import materialize


#: Edges that a task contracts at once.
CONTRACTED = 1_000_000


class Forest:
    """Union-find that keeps the links which joined two trees; a tree's root is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the links i-j, a set that spans what they join."""
        kept: list[np.ndarray] = []
        alive = np.arange(len(i))
        while len(alive):
            r, s = self.root(i[alive]), self.root(j[alive])
            open_ = r != s
            alive, r, s = alive[open_], r[open_], s[open_]
            if not len(alive):
                break
            hi, lo = np.maximum(r, s), np.minimum(r, s)
            order = np.lexsort((lo, hi))
            first = order[np.append(True, hi[order][1:] != hi[order][:-1])]
            self.up[hi[first]] = lo[first]  # each root hangs below one smaller root
            kept.append(alive[first])
        at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return i[at], j[at]

    def root(self, i: np.ndarray) -> np.ndarray:
        """Each node's root; on the way all paths are halved until every node hangs below its root itself."""
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above[i]
            self.up = above


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task, ``CONTRACTED`` at a time, to stars that join the same nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.add(at[: len(u)], at[len(u) :])
        root = forest.root(np.arange(len(nodes)))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])

    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= CONTRACTED:
            yield stars(held)
            held, many = [], 0
    if many:
        yield stars(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of some edge; the component is its smallest node.

    Tasks first contract the edges they hold to stars. Then large-star and small-star rounds alternate:
    every node hangs itself or its neighbours below the smallest node known nearby, until nothing
    changes; the number of rounds grows with the logarithm of the largest component. Each round is two
    aggregations by node; its edges are written to the shared folder. Hot nodes are neighbours of many:
    an aggregation by node combines map-side, the contraction leaves each task one edge for a node, and
    joins on a node are split where skewed. Null ends and loops are ignored.
    """
    own = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(*own).alias("u"), F.least(*own).alias("v")).where("u <> v")
    now = materialize(now.distinct().mapInArrow(_contract, "u long, v long"), "components")
    state = _state(now)
    while state["n"]:
        before = state
        now = _small_star(_large_star(now))
        now = materialize(now.distinct(), "components")
        state = _state(now)
        if state == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(edges: DataFrame) -> Row:
    """Number and checksum of the edges: alike before and after a round that changes nothing."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("sum")).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest among the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
