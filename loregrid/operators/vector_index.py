"""Approximate nearest vectors: trained cells, product codes of what is left, and an exact second look at the best.

Cells and codebooks are fitted on a bounded sample. Every vector is stored twice: by its code, in blocks of a cell, and whole, sorted by cell; a search reads the codes of the
cells nearest to its queries, and the whole vectors of the candidates alone.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import segments
from .vector import inner_product

#: Codes in a block, and queries that meet a block at once, at most.
BLOCK_ROWS, ASKED_ROWS = 4_096, 128


@dataclass
class Codebook:
    """cells: a centre for each; books: for each part of a vector the centres of what is left of it."""

    cells: np.ndarray
    books: np.ndarray  # parts, codes, size of a part

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, cells=self.cells, books=self.books)
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Codebook:
        held = np.load(io.BytesIO(blob))
        return cls(held["cells"], held["books"])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cell and the codes of each row."""
        cell = _nearest(x, self.cells)
        rest = (x - self.cells[cell]).reshape(len(x), len(self.books), -1)
        return cell, np.stack([_nearest(rest[:, j], b) for j, b in enumerate(self.books)], 1).astype(np.uint8)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _fitted(x: np.ndarray, many: int, rounds: int = 12) -> np.ndarray:
    """Lloyd rounds from evenly spaced rows; a centre that loses its rows stays."""
    centres = x[np.linspace(0, len(x) - 1, min(many, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        for k in np.unique(own):
            centres[k] = x[own == k].mean(0)
    return centres


def _whole(vectors: DataFrame, size: int) -> DataFrame:
    usable = (F.size("embedding") == size) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & usable)


def train(vectors: DataFrame, size: int, cells: int, parts: int = 16, codes: int = 256, sample_rows: int = 20_000) -> Codebook:
    """A codebook from the sample_rows vectors (id, embedding) whose ids have the smallest hashes: this bound holds at any size of the table. parts must divide size."""
    if size % parts:
        raise ValueError(f"{parts} parts don't divide {size}")
    near = _whole(vectors, size).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").collect()
    x = np.array([r.embedding for r in near], np.float64).reshape(-1, size)
    if not len(x):
        return Codebook(np.zeros((1, size)), np.zeros((parts, 1, size // parts)))
    centres = _fitted(x, cells)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    return Codebook(centres, np.stack([_fitted(rest[:, j], min(codes, len(x))) for j in range(parts)]))


def write(vectors: DataFrame, root: str, cells: int, size: int = 64, parts: int = 16, sample_rows: int = 20_000) -> Codebook:
    """Writes a new version of the index of vectors (id, embedding): every vector with size finite components; others can't be found."""
    spark = vectors.sparkSession
    book = train(vectors, size, cells, parts, sample_rows=sample_rows)
    kind = dict(vectors.dtypes)["id"]

    def placed(frames):
        for frame in frames:
            if len(frame):
                cell, code = book.coded(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": frame["id"], "code": [c.tobytes() for c in code], "embedding": frame["embedding"]})

    held = _whole(vectors, size).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows = held.mapInPandas(placed, f"cell int, id {kind}, code binary, embedding array<float>")
    segments.replace(rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), root, "vectors_whole", "id")

    def blocks(frames):
        at, ids, held = None, [], []
        for frame in frames:
            for cell, i, code in zip(frame["cell"], frame["id"], frame["code"]):
                if ids and (cell != at or len(ids) >= BLOCK_ROWS):
                    yield pd.DataFrame({"cell": [at], "ids": [ids], "codes": [b"".join(held)]})
                    ids, held = [], []
                at = cell
                ids.append(i)
                held.append(bytes(code))
        if ids:
            yield pd.DataFrame({"cell": [at], "ids": [ids], "codes": [b"".join(held)]})

    stored = segments.read(spark, root, "vectors_whole").select("cell", "id", "code")
    segments.replace(stored.sortWithinPartitions("cell", "id").mapInPandas(blocks, f"cell int, ids array<{kind}>, codes binary"), root, "vector_codes", options={"parquet.page.row.count.limit": "1"})
    segments.replace(spark.createDataFrame([(bytearray(book.packed()), size)], "book binary, size int"), root, "vector_book")
    return book


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 5, probes: int = 12, again: int = 64) -> DataFrame:
    """query_id, id, score (rounded to 4 digits), rank: k of the vectors with the largest inner products with each query (query_id, embedding), ties to the smaller id.

    A query's codes are compared in its probes nearest cells; of all these the again best are looked up whole and ranked exactly. Queries that are no vectors of the index's size find nothing.
    """
    r = segments.read(spark, root, "vector_book").first()
    book, size = Codebook.unpacked(bytes(r.book)), r["size"]
    n = min(probes, len(book.cells))
    asked = queries.select(F.col("query_id").alias("id"), "embedding")
    asked = _whole(asked, size).select("id", F.col("embedding").cast("array<double>").alias("embedding"))

    def visits(frames):
        for frame in frames:
            if len(frame):
                x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
                near = np.argpartition(-(x @ book.cells.T), n - 1, axis=1)[:, :n].astype(np.int32)
                yield pd.DataFrame({"cell": near.ravel(), "query_id": np.repeat(frame["id"].to_numpy(), n), "vector": np.repeat(np.array([v.tobytes() for v in x], object), n)})

    def compared(frames):
        for frame in frames:
            out = []
            for cell, ids, codes, names, asks in zip(*[frame[c] for c in ("cell", "ids", "codes", "names", "asks")]):
                code = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                ids = np.asarray(ids)
                for name, ask in zip(names, asks):
                    q = np.frombuffer(ask, np.float64)
                    table = np.einsum("jcs,js->jc", book.books, q.reshape(len(book.books), -1))
                    score = q @ book.cells[cell] + table[np.arange(len(table)), code].sum(1)
                    best = np.argpartition(-score, again - 1)[:again] if len(score) > again else np.arange(len(score))
                    out.append(pd.DataFrame({"query_id": name, "cell": np.int32(cell), "id": ids[best], "about": score[best]}))
            if out:
                yield pd.concat(out)

    of = asked.mapInPandas(visits, "cell int, query_id string, vector binary")
    split = of.groupBy("cell").agg(F.ceil(F.count("*") / ASKED_ROWS).alias("parts"))  # a row for each cell
    dealt = of.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts"))
    blocks = dealt.groupBy("cell", "part").agg(F.collect_list("query_id").alias("names"), F.collect_list("vector").alias("asks"))
    codes = segments.read(spark, root, "vector_codes")
    kind = dict(codes.dtypes)["ids"][6:-1]
    found = codes.join(blocks, "cell").select("cell", "ids", "codes", "names", "asks").mapInPandas(compared, f"query_id string, cell int, id {kind}, about double")
    close = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "id"))).where(F.col("place") <= again)
    held = segments.read(spark, root, "vectors_whole").select("cell", "id", F.col("embedding").alias("_v"))
    both = close.select("query_id", "cell", "id").join(held, ["cell", "id"]).join(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    exact = both.select("query_id", "id", F.round(inner_product(F.col("_v"), F.col("_q")), 4).alias("score"))
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
