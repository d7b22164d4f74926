"""Connected components of an edge table, by the two star steps of distributed union-find.

Each round links every neighbour of a node to the least node it knows, first the larger neighbours (large star), then the
others (small star), until no edge changes. A round's edges are written to the shared folder, so a lost executor
costs one round at most; a node of very many neighbours only adds rows, which aggregate before the shuffle or are split as skewed joins.

Where nodes are longs, the edges of a task become stars before the rounds, at most ``EDGES`` at a time: that leaves fewer edges and short ways. So few edges that one
such step takes them all (a fixed 8 MB) need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrainframe.llm.common import discard, materialise

EDGES = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): a task's edges as stars of the same components, v being the least."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        for k in range(0, 0 if batch is None else len(batch), EDGES):
            part = batch.slice(k, EDGES)
            if n + len(part) > EDGES:
                yield _joined(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    nodes, at = np.unique(np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(*at.reshape(2, -1).tolist(), strict=True):
        forest.join(x, y)
    root = np.fromiter(map(forest.root, range(len(nodes))), np.int64, len(nodes))
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    """(node, least): the least of each node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its least node. Null ends and loops are ignored."""
    up, down = F.greatest(a, b), F.least(a, b)
    now = materialise(edges.where(F.col(a) != F.col(b)).select(up.alias("u"), down.alias("v")).distinct(), "edges")
    state = lambda: now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while now.schema["u"].dataType == T.LongType():
        few = before[0] <= EDGES
        new = materialise((now.coalesce(1) if few else now).mapInArrow(_stars, now.schema), "task-stars")
        discard(now)
        now = new
        if few:
            return _named(now)
        before = state()
        if before[0] > EDGES:
            break
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(now)
        now, last = new, before
        before = state()
        if before == last:
            break
    else:
        raise RuntimeError("components: no end within the given rounds")
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Forest:
    """Union-find over 0 .. n-1; ``join`` tells whether the two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
