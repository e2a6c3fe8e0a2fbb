"""Connected components of a graph given as a table of edges.

A graph of TASK_EDGES at most is settled in one task. A larger one goes through rounds of large and small
stars, which shorten every path by a constant factor, until it has shrunk to that size or is a table of
stars, which is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, materialise

#: Rounds after which a run gives up with an error.
ROUNDS = 40
#: Edges that a task holds at a time, about 100 bytes each.
TASK_EDGES = 500_000

EDGES = "hi long, lo long"


def settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each can reach by them."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        one, two = root[x], root[y]
        lo, hi = np.minimum(one, two), np.maximum(one, two)
        if (lo == hi).all():
            return nodes, nodes[root]
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def _settled(whole: bool):
    """Rows (hi, lo): each node below its root; with whole, roots below themselves too."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(held, axis=1) if held else np.empty((2, 0), dtype=np.int64)
        nodes, roots = settle(*both)
        keep = slice(None) if whole else nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["hi", "lo"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches(it):
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            n += b.num_rows
            if n >= TASK_EDGES and not whole:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it can reach) of every node of `edges` (columns a and b, long, not null; loops are passed over).

    Rounds are two aggregations, whose minima combine before the shuffle, and two joins on a node. Tables
    are written to the shared folder, so that a lost executor costs one round at most.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "edges")
    sums = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(30,0)")).alias("h")).first()
    before = sums(now)
    for _ in range(ROUNDS):
        if before["n"] <= TASK_EDGES:
            found = materialise(now.coalesce(1).mapInArrow(_settled(True), EDGES), "components")
            discard(now)
            return found.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        # Large star: each node's larger neighbours go to its smallest neighbour. A node without a smaller
        # one keeps them, so only nodes that are the larger end somewhere are looked up. The lookup is
        # written: then both sides of the join are plain shuffles, and a centre with very many neighbours
        # can be split over tasks.
        least = materialise(now.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "n"), "least")
        large = now.join(least, F.col("lo") == F.col("n"), "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct()
        # Small star: each node's smaller neighbours, and the node, go to the smallest of them.
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        tied = large.join(root, "hi").where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        stars = tied.union(root.select("hi", F.col("root").alias("lo"))).where("hi > lo").distinct()
        then = materialise(stars, "stars")
        after = sums(then)
        discard(least)
        discard(now)
        same, now, before = after == before, then, after
        if same:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
