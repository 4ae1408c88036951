"""Fusing the retrieval legs, re-ranking, and the final cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literal_map, words
from ..schemas import KEYWORD_BOOST, OTHER_BOOST, TOP_K_MOST, TYPE_BOOST


def union(legs: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, leg, leg_ord, rank, id, score of legs (query_id, id, score, rank), in order."""
    each = [leg.select("query_id", F.lit(name).alias("leg"), F.lit(i).alias("leg_ord"), "rank", "id", "score") for i, (name, leg) in enumerate(legs)]
    return reduce(DataFrame.unionByName, each)


def fuse(candidates: DataFrame) -> DataFrame:
    """For each query and id the candidate with the highest score; the earlier leg and rank win ties."""
    best = F.max_by(F.struct("leg", "leg_ord", "rank", "score"), F.struct("score", -F.col("leg_ord"), -F.col("rank")))
    return candidates.groupBy("query_id", "id").agg(best.alias("b")).select("query_id", "id", "b.*")


def rerank(items: DataFrame) -> DataFrame:
    """items (query_id, query, id, type, content, score, leg_ord, rank) with final score and place.

    The score is boosted by type and by the query's words that the content holds (repeated words count again), rounded, and divided by the query's highest
    where that is above 1.
    """
    hits = F.size(F.filter(words(F.col("query")), lambda w: F.contains(F.lower(F.col("content")), w)))
    boosted = items.withColumn("boosted", F.round(F.col("score") * (literal_map(TYPE_BOOST, OTHER_BOOST)(F.col("type")) + KEYWORD_BOOST * hits), 4))
    top = F.max("boosted").over(Window.partitionBy("query_id"))
    final = boosted.withColumn("final", F.when(top > 1, F.round(F.col("boosted") / top, 4)).otherwise(F.col("boosted")))
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "leg_ord", "rank", "id")
    return final.withColumn("place", F.row_number().over(order)).drop("boosted")


def cut(items: DataFrame, min_score: float, top_k: int) -> DataFrame:
    """The first top_k (10 at most) of each query's items with at least min_score."""
    if not 0 <= min_score <= 1 or top_k < 1:
        raise ValueError("min_score must be from 0 to 1 and top_k positive")
    kept = items.where(F.col("final") >= min_score)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("place") <= min(top_k, TOP_K_MOST))


def diagnostics(candidates: DataFrame) -> DataFrame:
    """query_id, total_scanned: how many candidates the legs gave, before fusion."""
    return candidates.groupBy("query_id").agg(F.count("*").alias("total_scanned"))
