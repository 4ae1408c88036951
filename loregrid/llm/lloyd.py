"""Centroid clustering: plain Lloyd rounds in whole numbers, exact at every step."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: Scaled components stay below this, so that a distance over MOST_SIZE components is a long.
MOST = 1 << 26
MOST_SIZE = 256

#: Vectors that are compared with the centroids at once.
BLOCK = 2_048


def whole(vectors: DataFrame, size: int, scale: float = 256.0) -> DataFrame:
    """vec_id (as text) and numbers (floor(scale * x), in doubles, as little-endian 64-bit integers) of the vectors with exactly size components, none of them null or non-finite."""
    x = pick(vectors, "vec_id", "embedding").where(F.size("embedding") == size)
    x = x.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def packed(frames):
        for frame in frames:
            if len(frame):
                numbers = np.floor(np.stack(frame["embedding"].to_numpy()).astype(np.float64) * scale)
                if np.abs(numbers).max() >= MOST:
                    raise ValueError(f"a component is {MOST} or more after scaling: its squared distance may not be a long")
                yield pd.DataFrame({"vec_id": frame["vec_id"], "numbers": [row.tobytes() for row in numbers.astype("<i8")]})

    # as text, for pandas would turn whole numbers beside nulls into floating-point ones
    return x.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding").mapInPandas(packed, "vec_id string, numbers binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the number of the nearest centroid (the lowest of equals) and the squared distance, in 64-bit integers."""
    away = np.empty((len(centroids), len(x)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        away[k] = np.einsum("ij,ij->i", d, d)
    best = away.argmin(0)
    return best, away[best, np.arange(len(x))]


def _blocks(frame: pd.DataFrame, size: int):
    for i in range(0, len(frame), BLOCK):
        part = frame.iloc[i : i + BLOCK]
        yield part, np.frombuffer(b"".join(part["numbers"]), "<i8").reshape(-1, size)


def _sums(centroids: np.ndarray):
    """A row for each centroid that is nearest to some of the partition's vectors: its number, their count and their sums."""

    def run(frames):
        k, size = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for frame in frames:
            for _, x in _blocks(frame, size):
                best, _ = nearest(x, centroids)
                count += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                found, at = np.unique(best[order], return_index=True)
                total[found] += np.add.reduceat(x[order], at, axis=0)
        at = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": at, "many": count[at]} | {f"s{j}": total[at, j] for j in range(size)})

    return run


def _placed(centroids: np.ndarray):
    def run(frames):
        for frame in frames:
            for part, x in _blocks(frame, centroids.shape[1]):
                best, away = nearest(x, centroids)
                yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": best.astype(np.int32), "distance": away})

    return run


def fit(vectors: DataFrame, k: int, rounds: int, size: int, seed: str) -> np.ndarray:
    """Centroids after the rounds. vectors: a stored table as whole() makes it.

    They start as the k vectors whose `seed:<vec_id>` has the smallest SHA-256 in lowercase hex, in that order (fewer vectors: fewer centroids; of equal ids, the
    smaller vector in bytes first; a null id counts as empty). Each round sums up the vectors nearest to each centroid, a row for each centroid from each partition, merged by groupBy;
    k rows reach the driver, which takes floor(sum / count). Centroids without vectors stay as they are. Sums are longs: an overflow is an error.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("vec_id", F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "numbers").orderBy("key", "numbers").limit(k).collect()
    centroids = np.array([np.frombuffer(r.numbers, "<i8") for r in first], np.int64).reshape(len(first), size)
    schema = ", ".join(["cluster int", "many long", *[f"s{j} long" for j in range(size)]])
    for _ in range(rounds if len(first) else 0):
        sums = vectors.select("numbers").mapInPandas(_sums(centroids), schema)
        merged = sums.groupBy("cluster").agg(F.sum("many").alias("many"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(size)])
        after = centroids.copy()
        for r in merged.collect():  # k rows
            after[r.cluster] = [r[f"s{j}"] // r.many for j in range(size)]
        if (after == centroids).all():
            break  # further rounds would change nothing
        centroids = after
    return centroids


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2", scale: float = 256.0) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with exactly size components, none null or non-finite.

    A component x counts as floor(scale * x). Other vectors, null ones too, get no row; repeated rows and equal vectors each have theirs; ties go to the smaller
    number. No vectors give no rows. Other columns are not read. Components of 2 ** 26 or more after scaling are an error, as are more than 256 components, since a
    distance may then not be a long.
    Centroids (k * size numbers) go to the tasks, sums for each centroid come from each partition: nothing else leaves a task. The vectors are stored as whole numbers once.
    """
    if size > MOST_SIZE:
        raise ValueError(f"at most {MOST_SIZE} components")
    spark = vectors.sparkSession
    held = stored(whole(vectors, size, scale), "whole")
    centroids = fit(held, k, rounds, size, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = stored(held.mapInPandas(_placed(centroids), "vec_id string, cluster int, distance long"), "placed")
    per = {r.cluster: r.own for r in placed.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()}  # k rows
    texts = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(i, own, sum(per.values()), texts[i]) for i, own in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of), "cluster").select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
