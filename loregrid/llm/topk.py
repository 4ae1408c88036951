"""Exact top-k by inner product with M-trees.

Vectors go to the nearest of some pivots, and each such cell to trees of bounded size (a large cell to several). A tree's pages hold entries that route to pages
below; each has a pivot (one of the vectors), the covering radius of what lies below it and its distance to the pivot above. By Cauchy-Schwarz
q.x <= q.p + |q| * d(p, x): with the radius this bounds all vectors below an entry, and with the stored distance to the pivot above it bounds an entry before
its own product is computed. Pages are visited best bound first until no bound reaches the k-th best score. Cells are the pages above the trees: a query
visits its best cell's trees first, and its k-th best score from there is the limit for all others; cells whose bound lies below it never see the query.
Queries meet trees in blocks, by an equi-join on the cell.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, pick, stored

_SLACK = 1e-6


class MTree:
    """An M-tree over integer vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 256, fan: int = 32):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.page, self.fan = page, fan
        order, self.own = [], np.zeros(len(ids))  # own: distance of each vector to its leaf's pivot
        pivot, radius, above, span, below = [], [], [], [], []
        todo = [(np.arange(len(ids)), 0, 0.0, -1)] if len(ids) else []
        children: dict[int, list[int]] = {}
        while todo:
            rows, p, distance, parent = todo.pop()
            node = len(pivot)
            away = self._away(rows, p)
            pivot.append(p)
            radius.append(float(away.max()))
            above.append(distance)
            children.setdefault(parent, []).append(node)
            if len(rows) <= page:
                span.append((len(order), len(order) + len(rows)))
                order += rows.tolist()
                self.own[rows] = away
                continue
            span.append((0, 0))
            centres = self._centres(rows, min(fan, -(-len(rows) // page)))
            near = np.stack([self._away(rows, c) for c in centres])
            part = near.argmin(0)
            if (np.bincount(part, minlength=len(centres)) == len(rows)).any():  # equal vectors: dealt evenly
                part = np.arange(len(rows)) % len(centres)
                near = np.stack([self._away(rows, c) for c in centres])
            for i, c in enumerate(centres):
                if (part == i).any():
                    todo.append((rows[part == i], c, float(self._away(np.array([c]), p)[0]), node))
        below = [np.array(children.get(i, []), np.int64) for i in range(len(pivot))]
        at = np.array(order, np.int64)
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        self.ids, self.vectors, self.own = self.ids[at], self.vectors[at], self.own[at]
        self.pivot = place[np.array(pivot, np.int64)] if pivot else np.zeros(0, np.int64)
        self.radius, self.above, self.span, self.below = np.array(radius), np.array(above), span, below
        self.products = 0

    def _away(self, rows: np.ndarray, p: int) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - self.vectors[p]) ** 2).sum(1))

    def _centres(self, rows: np.ndarray, many: int) -> list[int]:
        """Each farthest from those before."""
        out, near = [int(rows[0])], self._away(rows, int(rows[0]))
        while len(out) < many:
            out.append(int(rows[near.argmax()]))
            near = np.minimum(near, self._away(rows, out[-1]))
        return out

    def packed(self) -> bytes:
        """Narrow vectors while it is stored."""
        held = dict(self.__dict__)
        if not len(self.vectors) or np.abs(self.vectors).max() < 1 << 15:
            held["vectors"] = self.vectors.astype(np.int16)
        return pickle.dumps(held, 5)

    @classmethod
    def unpacked(cls, blob: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(blob)
        tree.vectors = tree.vectors.astype(np.float64)
        return tree

    def search(self, query: np.ndarray, k: int, own: int | None = None, limit: float = -np.inf) -> list[tuple[int, int]]:
        """The k highest (score, id) of those with the score limit at least, ties to smaller ids; vectors with the id own take no part."""
        if not len(self.ids) or k < 1:
            return []
        q = query.astype(np.float64)
        size = float(np.sqrt(q @ q)) * (1 + 1e-12)
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        root = float(self.vectors[self.pivot[0]] @ q)
        self.products += 1
        heap = [(-(root + size * self.radius[0]), 0, root)]
        while heap:
            bound, node, product = heapq.heappop(heap)
            if -bound + _SLACK < limit:
                break
            below = self.below[node]
            if len(below):
                most = product + size * (self.above[below] + self.radius[below])
                near = below[most + _SLACK >= limit]
                products = self.vectors[self.pivot[near]] @ q
                self.products += len(near)
                for child, p, m in zip(near.tolist(), products.tolist(), (products + size * self.radius[near]).tolist()):
                    if m + _SLACK >= limit:
                        heapq.heappush(heap, (-m, child, p))
                continue
            start, end = self.span[node]
            rows = start + np.flatnonzero(product + size * self.own[start:end] + _SLACK >= limit)
            scores = self.vectors[rows] @ q
            self.products += len(rows)
            for i in np.flatnonzero(scores >= limit).tolist():
                at = int(self.ids[rows[i]])
                if at == own:
                    continue
                found = (int(scores[i]), -at)
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            limit = max(limit, best[0][0]) if len(best) == k else limit
        return [(s, -i) for s, i in sorted(best, reverse=True)]


#: Pivots of cells at most, for each length of vectors.
MOST_CELLS = 1_024


def _nearest(pivots: dict[int, np.ndarray]):
    """Rows of (vec_id, size, numbers) to (vec_id, size, numbers, cell, away): the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            size, numbers = np.asarray(batch.column("size")), batch.column("numbers")
            cell, away = np.zeros(len(size), np.int32), np.zeros(len(size))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                x = np.asarray(numbers.take(pa.array(rows)).flatten()).reshape(-1, n).astype(np.float64)
                p = pivots[int(n)]
                square = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)
                cell[rows] = square.argmin(1)
                away[rows] = np.sqrt(((x - p[cell[rows]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _pages(batches):
    """Rows of (cell, size, salt, vec_id, numbers), sorted, to (cell, size, salt, tree)."""
    at, held = None, []

    def made():
        tree = MTree(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int64()), pa.array([tree.packed()], pa.binary())], names=["cell", "size", "salt", "tree"])

    for batch in batches:
        for cell, size, salt, i, numbers in zip(*[batch.column(c).to_pylist() for c in ("cell", "size", "salt", "vec_id", "numbers")]):
            if (cell, size, salt) != at:
                if held:
                    yield made()
                at, held = (cell, size, salt), []
            held.append((i, numbers))
    if held:
        yield made()


def _visits(pivots: dict[int, np.ndarray], reach: dict[int, np.ndarray], first: bool, counted: bool = False):
    """Rows of (vec_id, size, numbers, cell, limit) to a row for each cell to visit: the best one, or all others whose bound reaches the limit. Bounds take cells without vectors as minus infinity.

    counted: only how many visits each cell gets, a row for each cell from each batch.
    """

    def run(batches):
        for batch in batches:
            size, out = np.asarray(batch.column("size")), [[], []]
            limits = np.asarray(batch.column("limit").fill_null(-np.inf))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                if int(n) not in pivots:
                    continue
                x = np.asarray(batch.column("numbers").take(pa.array(rows)).flatten()).reshape(-1, n).astype(np.float64)
                long = np.sqrt((x * x).sum(1)) * (1 + 1e-12)
                bound = x @ pivots[int(n)].T + long[:, None] * reach[int(n)]
                best = bound.argmax(1)
                if first:
                    out[0].append(rows)
                    out[1].append(best)
                else:
                    go = bound + _SLACK >= limits[rows][:, None]
                    go[np.arange(len(rows)), best] = False
                    go[np.isinf(bound)] = False
                    i, c = np.nonzero(go)
                    out[0].append(rows[i])
                    out[1].append(c)
            if out[0]:
                rows, cell = np.concatenate(out[0]), np.concatenate(out[1]).astype(np.int32)
                if counted:
                    (own, wide), many = np.unique(np.stack([cell, size[rows]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(wide, pa.int32()), pa.array(many, pa.int64())], names=["cell", "size", "many"])
                    continue
                for i in range(0, len(rows), 2_000):
                    at = pa.array(rows[i : i + 2_000])
                    part = [batch.column(c).take(at) for c in ("vec_id", "size", "numbers", "limit")]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(cell[i : i + 2_000])], names=["vec_id", "size", "numbers", "limit", "cell"])

    return run


def _blocks(most: int):
    """Rows of (cell, size, asks, vec_id, numbers, limit), sorted, to (cell, size, asked): ids, vectors and limits of a block's queries."""

    def run(batches):
        at, held = None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([pickle.dumps(held, 5)], pa.binary())], names=["cell", "size", "asked"])

        for batch in batches:
            for cell, size, asks, i, numbers, limit in zip(*[batch.column(c).to_pylist() for c in ("cell", "size", "asks", "vec_id", "numbers", "limit")]):
                if (cell, size, asks) != at or len(held) >= most:
                    if held:
                        yield made()
                    at, held = (cell, size, asks), []
                held.append((i, np.array(numbers, np.int64), -np.inf if limit is None else limit))
        if held:
            yield made()

    return run


def _found(k: int):
    def run(batches):
        last, tree = None, None
        for batch in batches:
            for blob, asked in zip(batch.column("tree").to_pylist(), batch.column("asked").to_pylist()):
                if blob != last:
                    last, tree = blob, MTree.unpacked(blob)
                out = []
                for i, numbers, limit in pickle.loads(asked):
                    out += [(i, hash(tuple(numbers.tolist())), at, score) for score, at in tree.search(numbers, k, own=i, limit=limit)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "version", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, tree_rows: int = 8_192, block_rows: int = 512, most_cells: int = MOST_CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over all vectors but those with its own vec_id.

    Both tables have vec_id and embedding; a component x counts as floor(scale * x). Ties go to the smaller vec_id. Vectors that are null, empty or hold null
    or non-finite components take no part, nor do null ids; vectors of different lengths don't meet. Repeated queries count once, repeated vectors each.
    Components must stay below 2 ** 26 / sqrt(length) after scaling for exact products. An empty table gives no rows; other columns are not read.
    Pivots of cells are a sample: of each length, the vectors whose vec_id has the smallest hash, one for tree_rows vectors, most_cells at most.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        x = pick(df, "vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
        x = x.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        return x.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("size"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("numbers"))

    held = clean(vectors)
    pivots = {}
    for r in held.groupBy("size").count().collect():  # a row for each length
        many = min(most_cells, -(-r["count"] // tree_rows))
        near = held.where(F.col("size") == r["size"]).orderBy(F.xxhash64("vec_id"), "vec_id", "numbers").limit(many).collect()
        pivots[r["size"]] = np.array([x.numbers for x in near], np.float64)
    placed = stored(held.mapInArrow(_nearest(pivots), "vec_id long, size int, numbers array<long>, cell int, away double"), "cells") if pivots else held.withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
    cells = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()  # most_cells rows for each length
    reach = {n: np.full(len(p), -np.inf) for n, p in pivots.items()}
    for c in cells:
        reach[c["size"]][c.cell] = c.reach
    salts = spark.createDataFrame([(c["size"], c.cell, -(-c.n // tree_rows)) for c in cells], "size int, cell int, salts long")
    key = ["cell", "size", "salt"]
    dealt = placed.join(F.broadcast(salts), ["size", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts"))
    trees = stored(dealt.repartition(parts(vectors), *key).sortWithinPartitions(*key).select(*key, "vec_id", "numbers").mapInArrow(_pages, "cell int, size int, salt long, tree binary"), "trees")

    def met(asked: DataFrame, first: bool) -> DataFrame:
        """Each cell's queries in as few blocks as hold them; a block goes to each tree of its cell, and a cell's trees are dealt by their number."""
        many = asked.mapInArrow(_visits(pivots, reach, first, counted=True), "cell int, size int, many long").groupBy("cell", "size").agg(F.sum("many").alias("many"))
        split = many.join(F.broadcast(salts), ["size", "cell"]).select("cell", "size", "salts", F.ceil(F.col("many") / block_rows).alias("blocks"))  # a row for each cell
        visits = asked.mapInArrow(_visits(pivots, reach, first), "vec_id long, size int, numbers array<long>, limit double, cell int").join(F.broadcast(split), ["cell", "size"])
        own = ["cell", "size", "asks"]
        placed = visits.withColumn("asks", F.pmod(F.xxhash64("vec_id"), "blocks")).repartition(parts(vectors), *own).sortWithinPartitions(*own)
        blocks = placed.select(*own, "vec_id", "numbers", "limit").mapInArrow(_blocks(block_rows), "cell int, size int, asked binary").join(F.broadcast(salts), ["size", "cell"])
        each = blocks.select("cell", "size", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        return trees.join(each, key).select("tree", "asked").mapInArrow(_found(k), "query_id long, version long, vec_id long, score long")

    asked = stored(clean(queries).distinct().withColumn("limit", F.lit(None).cast("double")), "asked")
    near = stored(met(asked, True), "near")
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    limits = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").cast("double").alias("most"))  # of an id's several vectors, the lowest
    full = near.select(F.col("query_id").alias("vec_id"), "version").distinct().groupBy("vec_id").agg(F.count("*").alias("seen"))
    again = asked.groupBy("vec_id").agg(F.count("*").alias("asked")).join(full, "vec_id").join(limits, "vec_id")
    one = again.where("asked = 1 AND seen = 1").select("vec_id", "most")  # ids with several vectors go on without a limit
    rest = asked.drop("limit").join(one, "vec_id", "left").withColumnRenamed("most", "limit")
    found = near.unionByName(met(rest, False))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
