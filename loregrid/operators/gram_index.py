"""Substring search by a trigram index: which of a tile's 64 nodes hold a run of three characters is one number, so a query's trigrams meet by AND, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import gathered, small_batches, starts
from ..sources import segments
from . import graph
from .fts_index import GIVEN_ROWS, of_terms, tile_ranges, within_grants

TILE_BITS = 6
#: Trigrams of a query that are read, the rarest first; the texts decide.
READ_GRAMS = 4
#: Bytes of nodes in a run.
RUN_BYTES = 1 << 20
PAGES = {"parquet.page.row.count.limit": "256", "parquet.block.size": str(32 << 20), "compression": "zstd"}
NODE_PAGES = {"parquet.page.row.count.limit": str(1 << TILE_BITS), "parquet.block.size": str(32 << 20), "compression": "zstd"}


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased. An array of one element binds the characters to a name, so they are made once."""
    chars = F.split(F.lower(text), "")
    runs = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))
    return F.array_distinct(F.flatten(F.transform(F.array(chars), runs)))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams, tiles and bits of nodes (tile, ord, content, id), in order for each run of nodes. A tile that spans runs has rows in each."""
    for nodes in gathered(batches, RUN_BYTES):
        tile, place = (nodes.column(c).to_numpy() for c in ("tile", "ord"))
        tiles, near = np.unique(tile, return_inverse=True)
        keys, owners = [], []
        for text in (nodes.column(c).combine_chunks() for c in ("content", "id")):
            sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            chars = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            whole = of[2:] == of[:-2]  # no run crosses texts
            keys.append(((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[whole])
            owners.append(of[2:][whole])
        held, code = np.unique(np.concatenate(keys), return_inverse=True)
        owner = np.concatenate(owners)
        # runs are numbered in the order of their characters, which is that of the terms
        key = code * len(tiles) + near[owner]
        pair = np.unique(key << TILE_BITS | place[owner])
        key, bit = pair >> TILE_BITS, np.left_shift(1, pair & ((1 << TILE_BITS) - 1))
        at = starts(key)
        if not len(at):
            continue
        bits = np.bitwise_or.reduceat(bit, at)
        points = np.stack([held >> 42, held >> 21 & 0x1FFFFF, held & 0x1FFFFF], 1).astype(np.uint32)
        terms = pa.array([points[i : i + 1].tobytes().decode("utf-32-le", "surrogatepass") for i in range(len(points))], pa.string())
        term, where = np.divmod(key[at], len(tiles))
        out = pa.RecordBatch.from_pydict({"term": terms.take(pa.array(term)), "tile": pa.array(tiles[where]), "bits": pa.array(bits)})
        for i in range(0, out.num_rows, GIVEN_ROWS):
            yield out.slice(i, GIVEN_ROWS)


def write(nodes: DataFrame, root: str) -> None:
    """Writes a new version of the index of nodes (id, type, content): the nodes by tile and place, and each trigram's nodes of each tile as bits."""
    spark = nodes.sparkSession
    small_batches(spark)
    at = F.monotonically_increasing_id()
    placed = nodes.select("id", "type", "content", at.alias("_at"))
    placed = placed.select(F.shiftright("_at", TILE_BITS).alias("tile"), F.col("_at").bitwiseAND(F.lit((1 << TILE_BITS) - 1)).cast("int").alias("ord"), "id", "type", "content")
    segments.replace(placed, root, "gram_nodes", options=NODE_PAGES)
    held = segments.read(spark, root, "gram_nodes").select("tile", "ord", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("content", "id")])
    segments.replace(held.mapInArrow(_bits, "term string, tile bigint, bits bigint"), root, "grams", options=PAGES)
    files = segments.read(spark, root, "grams").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).withColumn("first", F.lit(True))
    segments.replace(files, root, "grams_files")


def substring(spark: SparkSession, root: str, queries: DataFrame, k: int = 30, types: list[str] | None = None, chunks: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """As graph.substring(), from the index below root: only tiles whose bits are left are read, and only their nodes compared. allowed (query_id, module) keeps nodes whose chunks' modules a query may see.

    Queries of fewer than three characters have no trigram and are compared with every node: the exact scan, for those queries alone.
    """
    asked = queries.select("query_id", "query", F.lower("query").alias("q"))
    nodes = segments.read(spark, root, "gram_nodes")
    wide = asked.where(F.length("q") >= 3)
    grams = wide.select("query_id", F.explode(grams_of(F.col("q"))).alias("term"))
    words = sorted(r.term for r in grams.select("term").distinct().collect())  # a batch's trigrams
    rows = of_terms(spark, root, "grams", words)
    df = rows.groupBy("term").agg(F.sum(F.bit_count("bits")).alias("df"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    rare = grams.join(F.broadcast(df), "term", "left").withColumn("k", F.row_number().over(order)).where(F.col("k") <= READ_GRAMS).select("query_id", "term").collect()  # a few for each query
    some = spark.createDataFrame(rare, "query_id string, term string")
    many = some.groupBy("query_id").agg(F.count("*").alias("many"))
    whole = of_terms(spark, root, "grams", sorted({r.term for r in rare})).groupBy("term", "tile").agg(F.bit_or("bits").alias("bits"))
    met = whole.join(F.broadcast(some), "term").groupBy("query_id", "tile").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    left = met.join(F.broadcast(many), "query_id").where("n = many AND bits <> 0").select("query_id", "tile", "bits")
    near = tile_ranges(left)
    some_nodes = nodes if near is None else nodes.where(near)
    sent = F.broadcast(left) if left.limit(segments.SENT + 1).count() <= segments.SENT else left  # so that nodes, with their texts, aren't exchanged
    pairs = some_nodes.join(sent, "tile").where(F.expr("(bits & shiftleft(1L, ord)) <> 0")).drop("bits").join(F.broadcast(wide), "query_id")  # the batch
    short = asked.where(F.length("q") < 3)
    if not short.isEmpty():
        pairs = pairs.unionByName(nodes.crossJoin(F.broadcast(short)))  # the batch's short queries, each against all nodes
    if types:
        pairs = pairs.where(F.col("type").isin(types))
    found = pairs.where(F.contains(F.lower("content"), F.col("q")) | F.contains(F.lower("id"), F.col("q")))
    return graph.ranked_hits(within_grants(found, chunks, allowed) if allowed is not None else found, k)
