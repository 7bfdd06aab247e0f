"""Connected components by repeated random contraction, entirely in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm.shared import saved, ship

#: Edges that one task takes: 16 bytes each.
BOUND = 1 << 21


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, to): the smallest node of each node's component, in one task.

    Roots of larger number hang themselves below smaller neighbours, all at once, until no edge joins two trees."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while not np.array_equal(above := root[root], root):
            root = above
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["at", "to"])


def components(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: long); component is its smallest node.

    In each round every node moves to the neighbour with the smallest random rank, or stays if
    its own is smaller, and the graph is rewritten on what is left, a constant factor fewer nodes
    whatever its shape.  A hub costs one partial aggregate; nothing is collected.  What is left at last, `bound`
    edges at most, one task joins."""
    ship(edges.sparkSession)
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "zedges")
    now: DataFrame | None = None
    turn = 0
    while (many := left.count()) > 0:
        if many <= bound:
            moved = saved(left.coalesce(1).mapInArrow(_joined, "at long, to long"), "zmoved")
        else:
            rank = lambda c, k=turn: F.xxhash64(F.lit(k), c)
            both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("v"))).alias("m"))
            own = F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("v"))
            moved = saved(best.select(F.col("a").alias("at"), F.when(own < F.col("m"), F.col("a")).otherwise(F.col("m.v")).alias("to")), "zmoved")
        if now is None:
            now = moved.select(F.col("at").alias("node"), F.col("to").alias("cur"))
        else:
            step = now.join(moved, F.col("cur") == F.col("at"), "left").select("node", F.coalesce("to", "cur").alias("cur"))
            now = saved(step, "zlabels")
        if many <= bound:
            break
        to = lambda c, m=moved: m.select(F.col("at").alias(c), F.col("to").alias(f"{c}2"))
        again = left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        left = saved(again.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "zedges")
        turn += 1
    if now is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = now.groupBy("cur").agg(F.min("node").alias("component"))
    return now.join(least, "cur").select("node", "component")
