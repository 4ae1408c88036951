"""The relation graph: building it, substring retrieval and traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences

# Scores of hits, and the relations that a stored graph follows.
ID_SCORE, BASE_SCORE, HIT_SCORE, MOST_HITS, MOST_NEIGHBOURS, KEYWORD_CHARS = 0.85, 0.90, 0.05, 3, 5, 80
RELATIONS = ["RELATED_TO", "CALLS", "IMPLEMENTS"]


def nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "type", "content")


def chain_edges(chunks: DataFrame, group: str = "source_path", order: str = "id") -> DataFrame:
    """An edge from each chunk to the next of its group."""
    return chunks.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy(group).orderBy(order)).alias("dst")).where("dst IS NOT NULL").withColumn("relation", F.lit("RELATED_TO"))


def call_edges(methods: DataFrame) -> DataFrame:
    """An edge from each method (id, name, calls) to those with the name that it calls."""
    called = methods.select(F.col("id").alias("src"), F.explode("calls").alias("name"))
    return called.join(methods.select(F.col("id").alias("dst"), "name"), "name").select("src", "dst", F.lit("CALLS").alias("relation")).distinct()


def upsert_nodes(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """old with new's rows in place of those with the same id. Of new rows with the same id, that with the largest order stays, or else the first as JSON."""
    row = F.struct(*[F.col(c) for c in new.columns])
    last = F.max_by(row, F.struct(order, F.to_json(row))) if order else F.min_by(row, F.to_json(row))
    new = new.groupBy("id").agg(last.alias("_row")).select("_row.*")
    new = new.drop(order) if order and order not in old.columns else new
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def upsert_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One edge for each ordered pair: the last."""
    return edges.groupBy("src", "dst").agg(F.max_by("relation", order).alias("relation"))


def substring(graph: DataFrame, queries: DataFrame, k: int = 30, types: list[str] | None = None) -> DataFrame:
    """query_id, id, type, content, score, rank: nodes whose content or id holds the query's text, whatever the case, of a small batch of queries (query_id, query).

    Ranked by the score before it is cut at 1, then by id. An empty query is in every node.
    """
    g = graph.where(F.col("type").isin(types)) if types else graph
    q = F.lower(F.col("query"))
    pairs = g.crossJoin(F.broadcast(queries.select("query_id", "query")))  # a batch of queries, each against all rows
    return ranked_hits(pairs.where(F.contains(F.lower("content"), q) | F.contains(F.lower("id"), q)), k)


def ranked_hits(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, type, content, score, rank of the k best of found (query_id, query, id, type, content)."""
    q = F.lower(F.col("query"))
    n = occurrences(F.lower("content"), q)
    raw = F.when(n > 0, BASE_SCORE + HIT_SCORE * F.least(n, F.lit(MOST_HITS))).otherwise(ID_SCORE)
    found = found.withColumn("raw", F.round(raw, 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "type", "content", F.least(F.col("raw"), F.lit(1.0)).alias("score"), "rank")


def keyword(graph: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """query_id, id, score, related: nodes that hold the first characters of the query as they are, and what they point at; one score for all, ranked by id."""
    pairs = graph.crossJoin(F.broadcast(queries.select("query_id", F.left("query", F.lit(KEYWORD_CHARS)).alias("_q"))))
    found = pairs.where(F.contains("id", F.col("_q")) | F.contains("content", F.col("_q")))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("rank") <= k)
    near = edges.where(F.col("relation").isin(RELATIONS)).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("related"))
    return found.join(near, found.id == near.src, "left").select("query_id", "id", F.lit(ID_SCORE).alias("score"), F.coalesce("related", F.expr("CAST(array() AS array<string>)")).alias("related"))


def neighbours(graph: DataFrame, edges: DataFrame, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """id, related_entity: the first few nodes that each node points at, joined by commas."""
    ranked = edges.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("k") <= most)
    near = ranked.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("dst")), ", ").alias("related_entity"))
    return graph.select("id").join(near, graph.id == near.src, "left").select("id", "related_entity")


def within(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node, hop: what each start (id) reaches in so many hops, with the fewest hops. A few starts; each round joins only what the last one found."""
    reached = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hop"))
    last = reached
    for hop in range(1, hops + 1):
        near = last.join(edges, last.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        last = near.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(last)
    return reached


def two_hop(edges: DataFrame) -> DataFrame:
    """src, dst: nodes two edges apart, each once, not counting the way back."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), F.col("dst").alias("dst"))
    return a.join(b, "mid").where("src <> dst").select("src", "dst").distinct()
