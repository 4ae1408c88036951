"""Vector retrieval: exact inner products, an approximate form by cells, and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import gathered


def inner_product(a: Column, b: Column) -> Column:
    """Summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Bytes of vectors that a task multiplies at a time, and products that it holds.
RUN_BYTES, PRODUCTS = 8 << 20, 1 << 22
#: Components up to this are multiplied as matrices; vectors with others meet the queries one by one.
LARGEST = 1e6
#: Scores are rounded to 4 digits: what lies within this of a k-th product may come before it.
SLACK = 2e-4


def _near(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 0) -> DataFrame:
    """query_id, id, type, score (rounded) of pairs of vectors (id, type, embedding) and queries (query_id, _q), among which are each query's k best; with cells only of pairs whose _cell is in _cells.

    Products of matrices tell which pairs may be among a block's k best; those are summed in the order that inner_product() has. Vectors of another length than the first query's, or without, null, not
    finite or very large components, have no place in a matrix and meet the queries one by one.
    """
    asked = queries.toArrow()  # a batch of queries, as for a broadcast
    held = asked.column("_q").to_pylist()
    n = next((len(v) for v in held if v), 1)
    fine = lambda c: F.coalesce((F.size(c) == n) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST)), F.lit(False))
    is_even = np.array([bool(v) and len(v) == n and all(x is not None and abs(x) <= LARGEST for x in v) for v in held], bool)
    each = queries.withColumn("_cell", F.explode("_cells")) if cells else queries
    meet = lambda v, q: v.join(F.broadcast(q), "_cell") if cells else v.crossJoin(F.broadcast(q))
    pairs = meet(vectors.where(~fine(F.col("embedding"))), each)
    if not is_even.all():
        pairs = pairs.unionByName(meet(vectors.where(fine(F.col("embedding"))), each.where(~fine(F.col("_q")))))
    rest = pairs.select("query_id", "id", "type", inner_product(F.col("embedding"), F.col("_q")).alias("score"))
    names = asked.column("query_id").combine_chunks().filter(pa.array(is_even))
    q = np.array([v for v, even in zip(held, is_even) if even], np.float64).reshape(-1, n)
    probed = np.array([np.isin(np.arange(cells), c) for c, even in zip(asked.column("_cells").to_pylist(), is_even) if even]) if cells else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, RUN_BYTES):
            x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            step = max(1, PRODUCTS // len(x))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                products = part @ x.T
                if cells:
                    products[~probed[at : at + step][:, rows.column("_cell").to_numpy()]] = -np.inf
                least = np.partition(products, len(x) - k, 1)[:, len(x) - k] if k < len(x) else np.full(len(part), -np.inf)
                off = SLACK + 4 * n * np.finfo(float).eps * np.linalg.norm(part, axis=1).max() * np.linalg.norm(x, axis=1).max()
                i, j = np.nonzero((products >= (least - off)[:, None]) & (products > -np.inf))
                score = np.zeros(len(i))
                for d in range(n):
                    score += x[j, d] * part[i, d]
                found = [names.take(pa.array(at + i)), *[rows.column(c).combine_chunks().take(pa.array(j)) for c in ("id", "type")], pa.array(score)]
                yield pa.RecordBatch.from_arrays(found, ["query_id", "id", "type", "score"])

    found = vectors.where(fine(F.col("embedding"))).mapInArrow(run, rest.schema) if len(q) else rest.limit(0)
    return found.unionByName(rest).withColumn("score", F.round("score", 4))


def _dealt(vectors: DataFrame) -> DataFrame:
    """vectors over all cores: a small file has much to be done."""
    return vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def top(vectors: DataFrame, queries: DataFrame, k: int = 5, types: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """query_id, id, score (rounded to 4 digits), rank: the k nearest vectors (id, embedding, type) of each of a small batch of queries (query_id, embedding).

    types keeps only those types: after the k are chosen, so fewer may remain, or before with prefilter. Ties go to the smaller id.
    """
    v = vectors.where(F.col("type").isin(types)) if types and prefilter else vectors
    best = _ranked(_near(_dealt(v.select("id", "type", "embedding")), queries.select("query_id", F.col("embedding").alias("_q")), k), k)
    return best.where(F.col("type").isin(types)) if types and not prefilter else best


def top_by_cells(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 10) -> DataFrame:
    """As top(), but each query meets only the vectors of its nearest cells; centres: a row for each cell."""
    table = [[float(x) for x in c] for c in centres]

    def cells(e: Column, n: int) -> Column:
        scores = F.array(*[F.struct((-inner_product(e, F.array(*[F.lit(x) for x in c]))).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(table)])
        return F.transform(F.slice(F.sort_array(scores), 1, n), lambda s: s["cell"])

    v = _dealt(vectors.select("id", "embedding")).select("id", F.lit(None).cast("string").alias("type"), "embedding", cells(F.col("embedding"), 1)[0].alias("_cell"))
    q = queries.select("query_id", F.col("embedding").alias("_q"), cells(F.col("embedding"), probes).alias("_cells"))
    return _ranked(_near(v, q, k, len(table)), k).drop("type")


def hashed_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder without a model: signed feature hashing of words, unit length."""
    import xxhash

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                row[h % size] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(row))
            if n:
                row /= n
        return out

    return embed


def embedded(chunks: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "content") -> DataFrame:
    """chunks with embedding; make is called once for each worker and stream of batches, so a model loads once."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())), index=texts.index)

    return chunks.withColumn("embedding", run(F.col(column)))
