"""The engine: search and prompt assembly over a corpus, for a batch of queries at a time."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fts, fusion, graph, prompt, vector
from ..schemas import CANDIDATE_MULTIPLIER, MIN_SCORE

def fixed_leg(found: DataFrame | None = None) -> Callable[..., DataFrame]:
    """A leg that gives the rows of found (query_id, id, score, rank) whatever is asked; without found none, as a source that isn't there."""

    def leg(queries: DataFrame, k: int) -> DataFrame:
        if found is None:
            return queries.sparkSession.createDataFrame([], "query_id string, id string, score double, rank int")
        return found.join(F.broadcast(queries.select("query_id")), "query_id", "left_semi").where(F.col("rank") <= k)

    return leg


#: A leg takes the queries, how many candidates to give, and types and module or None, and returns query_id, id, score, rank. Legs of two arguments are filtered afterwards.
Leg = Callable[..., DataFrame]


@dataclass
class Engine:
    """chunks: CHUNK columns. vectors: id, type, embedding, with queries' embeddings in the queries' column embedding. Legs run in this order.

    second: a second stage that gives the re-ranked candidates their places anew, as late.rerank() does.
    """

    chunks: DataFrame
    vectors: DataFrame | None = None
    mode: str = "ranked"
    legs: dict[str, Leg] = field(default_factory=dict)
    second: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if not self.legs:
            self.legs = {"bm25": lambda q, k, types=None, module=None: fts.bm25(self.chunks, q, self.mode, k, types, module)}
            if self.vectors is not None:
                self.legs["vector"] = lambda q, k: vector.top(self.vectors, q, k)
            self.legs["graph"] = lambda q, k, types=None, module=None: graph.substring(graph.nodes(self.chunks), q, k, types)

    def candidates(self, queries: DataFrame, top_k: int = 5, types: list[str] | None = None, module: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """Legs that take types, module and allowed (query_id, module: what a query may see) choose by them before they cut."""
        k = top_k * CANDIDATE_MULTIPLIER
        filters = lambda leg: {n: v for n, v in (("types", types), ("module", module), ("allowed", allowed)) if n in inspect.signature(leg).parameters}
        return fusion.union([(name, leg(queries, k, **filters(leg))) for name, leg in self.legs.items()])

    def search(self, queries: DataFrame, top_k: int = 5, min_score: float = MIN_SCORE, types: list[str] | None = None, module: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, place, id, type, content, title, module, leg, score of the best chunks of queries (query_id, query), by the filters; see permissions.allowed() for allowed."""
        found = fusion.fuse(self.candidates(queries, top_k, types, module, allowed))
        chunks = self.chunks.where(F.col("type").isin(types)) if types else self.chunks
        chunks = chunks.where(F.col("module") == module) if module else chunks
        items = F.broadcast(found).join(chunks.select("id", "type", "content", "title", "module", "meta_json"), "id").join(F.broadcast(queries.select("query_id", "query")), "query_id")
        items = items.join(F.broadcast(allowed), ["query_id", "module"], "left_semi") if allowed is not None else items  # what legs without grants found
        ranked = fusion.rerank(items)
        best = fusion.cut(self.second(ranked) if self.second else ranked, min_score, top_k)
        return best.select("query_id", "place", "id", "type", "content", "title", "module", "meta_json", "leg", F.col("final").alias("score"))

    def prompts(self, queries: DataFrame, max_tokens: int = 4096, role: str | None = None, **how) -> DataFrame:
        """Search, then prompts from what it finds: sanitised, deduplicated, cut to the budget. queries may have architecture and dependencies, see prompt.assemble() and prompt.assembled()."""
        items = self.search(queries, **how).withColumn("ord", F.col("place"))
        fields = ("version", "since_version", "deprecated_in", "security_rule", "code_example", "related_entity")
        meta = F.from_json("meta_json", "knowledge_source STRING, " + ", ".join(f"{f} STRING" for f in fields))
        items = items.withColumn("m", meta).select("query_id", "id", "type", "content", "score", "ord", F.col("m.knowledge_source").alias("source"), *[f"m.{f}" for f in fields])
        items = prompt.sanitize(items, fields).drop("modified")  # the content is sanitised below; what is read of the meta data goes into the prompt too
        more = [c for c in ("architecture", "dependencies") if c in queries.columns]
        requests = queries.select("query_id", "query", F.lit(max_tokens).alias("max_tokens"), F.lit(role).cast("string").alias("role"), *more)
        return prompt.assembled(items, requests)
