"""Connected components over edges that need not fit in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges (16 bytes each) that one task joins by itself; more are joined by rounds of exchanges.
ALONE = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each node's component) of edges, by union and find; smallest nodes themselves are left out."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))  # in the names' order, so the smaller number is the smaller node

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(names))], np.int64)
    child = root != np.arange(len(names))
    return names[child], names[root[child]]


def _contracted(most: int):
    """A task's edges to stars that connect the same nodes, some edges at a time."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column("a")), np.asarray(batch.column("b"))))
            count += batch.num_rows
            if count >= most:
                a, b = forest(*(np.concatenate(x) for x in zip(*held)))
                held, count = [(a, b)], len(a)
                if count >= most // 2:  # hardly smaller: on to the exchange
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    held, count = [], 0
        if count:
            a, b = forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of edges (a, b).

    Every task first contracts its own edges to stars. Up to `alone` edges are contracted in one task and done. Beyond, large-star and small-star steps follow in
    turn until no edge changes; every step is a grouped minimum (combined before the exchange) and a join that can be split where one node has many edges.
    Null ends don't count; without edges there are no rows.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    few = now.count() <= alone
    now = (now.coalesce(1) if few else now).mapInArrow(_contracted(max(4, 4 * alone)), "a long, b long")
    now = stored(now if few else _directed(now), "edges")
    before = None
    while not few:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _directed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(_directed(small), "edges")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
