"""The ingest run: files and Java sources to chunks, and chunks to the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fts_index, gram_index, graph, ingest, late, vector
from ..schemas import CHUNK
from ..sources.corpus import current_index, poms, resolved_versions, version_overrides, write_index
from .engine import Engine


def modules_of(files: DataFrame, root_name: str = "") -> DataFrame:
    """pom_dir, artifact_id, resolved of the pom.xml files among files; without any, one module of the root folder's name."""
    found = resolved_versions(poms(files), version_overrides(files)).select("pom_dir", "artifact_id", "resolved")
    return files.sparkSession.createDataFrame([("", root_name, "")], found.schema) if found.isEmpty() else found


def chunks_of(files: DataFrame, root_name: str = "") -> DataFrame:
    """Chunks of files (path, filename, content): documents by classified text, Java sources by public member."""
    docs = files.where(~F.endswith("path", F.lit(".java")) & ~F.col("filename").isin("pom.xml", ".sdk-versions.json"))
    kind = ingest.classified(F.col("path"), F.col("content"))
    module = F.when(F.contains("path", F.lit("/")), F.split("path", "/")[0]).otherwise("")
    made = ingest.chunked(docs.select("path", "content", kind.alias("type"), F.regexp_replace("filename", r"\.[^.]*$", "").alias("title"), module.alias("module")))
    java = ingest.java_methods(files.select("path", "content"), modules_of(files, root_name))
    names = [c.split()[0] for c in CHUNK.split(", ")]
    row = F.struct(*names)
    return made.select(names).unionByName(java.select(names)).groupBy("id").agg(F.min_by(row, F.to_json(row)).alias("c")).select("c.*")


def run(files: DataFrame, root: str, embed: Callable | None = None, root_name: str = "") -> dict[str, int]:
    """Writes chunks, the full-text and trigram indexes, vectors and edges below root, and returns the counts of what was written.

    Readers see the new version of a table once it is complete. Chunks that share an id (overloads) are one.
    """
    spark = files.sparkSession
    write_index(chunks_of(files, root_name), root, "chunks", "id")
    return index(current_index(spark, root, "chunks"), root, embed) | {"doc_files": files.where(~F.endswith("path", F.lit(".java")) & ~F.col("filename").isin("pom.xml", ".sdk-versions.json")).count()}


def index(chunks: DataFrame, root: str, embed: Callable | None = None) -> dict[str, int]:
    """Writes the index tables of chunks below root, and returns their counts."""
    spark = chunks.sparkSession
    fts_index.write(chunks, root)
    write_index(vector.embedded(chunks, embed or vector.hashed_embedder).select("id", "type", "embedding"), root, "vectors", "id")
    gram_index.write(graph.nodes(chunks), root)
    late.write(chunks, root)
    write_index(graph.chain_edges(chunks), root, "edges")
    java = F.get_json_object("meta_json", "$.knowledge_source") == "sdk_code"
    n = chunks.agg(F.count("*").alias("total"), F.count_if(java).alias("java")).first()
    held = {name: current_index(spark, root, table).count() for name, table in (("indexed_vector", "vectors"), ("graph_nodes", "gram_nodes"), ("graph_edges", "edges"))}
    figures = current_index(spark, root, "figures").first()
    return {"doc_chunks": n.total - n.java, "java_chunks": n.java, "total_chunks": n.total, "indexed_bm25": figures.n} | held


def stored_engine(spark, root: str, chunks: DataFrame | None = None, queries_embedded: bool = False, late_interaction: bool = False) -> Engine:
    """An engine whose legs read the index below root: blocks of the batch's terms, nodes by trigrams, and vectors where queries have an embedding. chunks: those indexed, if they aren't stored.

    late_interaction: candidates are ranked a second time by their tokens' codes.
    """
    chunks = current_index(spark, root, "chunks") if chunks is None else chunks
    legs = {"bm25": lambda q, k, types=None, module=None, allowed=None: fts_index.top(root, q, k, chunks, types, module, allowed)}
    if queries_embedded:
        legs["vector"] = lambda q, k: vector.top(current_index(spark, root, "vectors"), q, k)
    legs["graph"] = lambda q, k, types=None, allowed=None: gram_index.substring(spark, root, q, k, types, chunks, allowed)
    return Engine(chunks, legs=legs, second=(lambda items: late.rerank(items, root)) if late_interaction else None)
