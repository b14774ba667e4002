"""Connected components of large edge sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from market_signals.llm.common import forget, keep, tidy

#: Edges that a task thins out at once.
HELD = 500_000


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a > b) as stars: of every load of edges each node that isn't the smallest of its component is tied to that one."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held), axis=0)
        nodes, at = np.unique(pairs, return_inverse=True)
        up = list(range(len(nodes)))
        for i, j in at.reshape(-1, 2).tolist():
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if i != j:
                up[max(i, j)] = min(i, j)
        for i in range(len(up)):
            up[i] = up[up[i]]
        root = np.array(up, np.int64)
        tied = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["a", "b"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        pairs = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        held.append(pairs[pairs[:, 0] != pairs[:, 1]])
        size += len(held[-1])
        if size >= HELD:
            yield told(held)
            held, size = [], 0
    if size:
        yield told(held)
    tidy()


def components(edges: DataFrame, most_rounds: int = 60, thin: bool = True) -> DataFrame:
    """node, component (the smallest node reachable) of every node of `edges` (a, b: bigint) that has another node as neighbour.

    Edges are first thinned out within each task (unless `thin` is False: they are already), and again once those of one
    node are together. Then large-star and small-star steps alternate: each node links its larger (or all smaller)
    neighbours to its smallest one, until every node has one edge, to a root. Groups are aggregated to their minimum,
    never collected, and every step's edges are written to the shared folder. An empty edge set gives no rows. Raises an
    error if `most_rounds` don't suffice.
    """
    edges = edges.where("a is not null and b is not null")
    edges = edges.mapInArrow(thinned, "a bigint, b bigint") if thin else edges
    edges = keep(edges.repartition("a").mapInArrow(thinned, "a bigint, b bigint"))
    for _ in range(most_rounds):
        # a star forest: every node with an edge to a smaller one has one such edge, and none leads to it
        nodes = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if not open_.limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # only a node that has a smaller neighbour changes its edges: the root of a large star, whose edges stay, meets nothing in this join
        moved = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m").where("m < n")
        large = edges.join(moved, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = keep(small)
        forget(edges)
        edges = new
    else:
        raise RuntimeError(f"components aren't done after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
