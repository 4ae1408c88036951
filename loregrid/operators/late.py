"""Second-stage re-ranking by late interaction: for each token of a query the most similar token of a chunk counts, summed over the query's tokens.

A token's vector is 60 signs in one number: 32 from the token, 12 from its first four characters, 8 each from its neighbours on either side, so the same word in the same
company is nearer than the word alone, and forms of a word are nearer than strangers. Similarity is signs that agree less signs that don't. An encoder of other signs can be given.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.batches import small_batches
from ..sources import segments
from .fts import terms_joined

SIGNS = 60
#: A row group's Bloom filter tells ids that are not there, whatever the order of the source.
PAGES = {"parquet.page.row.count.limit": "16", "parquet.block.size": str(32 << 20), "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": "20000"}
#: Chunks that a scan names one by one; of more, the table is read and joined.
NAMED_IDS = 1_000
#: Values of one IN that the Parquet reader checks page by page; a longer list counts as its range there.
IN_VALUES = 10


@functools.lru_cache(1 << 16)
def _signs(token: str) -> int:
    """The first 64 bits of a token's MD5; a worker keeps those of its last tokens."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _codes(joined: pa.Array) -> pa.Array:
    """The distinct codes, in order, of tokens joined by spaces. A batch's tokens are hashed once, however often they stand."""
    words = pc.split_pattern(pc.if_else(pc.equal(joined, ""), None, joined), " ")
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    held = coded.dictionary.to_pylist()
    whole, none = np.array([_signs(t) for t in held], np.uint64), _signs("")
    stem = {t: _signs(t) for t in {t[:4] for t in held}}
    own = whole >> 32 << 28 | np.array([stem[t[:4]] for t in held], np.uint64) >> 20 << 52 >> 36
    at, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    before, after = (np.full(len(at), none >> shift & 0xFF, np.uint64) for shift in (12, 4))
    beside = row[1:] == row[:-1]
    before[1:][beside] = (whole >> 12 & 0xFF)[at[:-1]][beside]
    after[:-1][beside] = (whole >> 4 & 0xFF)[at[1:]][beside]
    code = (own[at] | before << 8 | after).astype(np.int64)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    first = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))[: len(code)]
    ends = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(sizes))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[first]))


def coded(rows: DataFrame, column: str) -> DataFrame:
    """rows with codes: the distinct codes of the text column's tokens, in order; a null text has none."""
    small_batches(rows.sparkSession)
    return rows.withColumn("codes", _codes(terms_joined(F.coalesce(column, F.lit("")))))


def write(chunks: DataFrame, root: str, encode: Callable[[DataFrame, str], DataFrame] = coded) -> None:
    """Writes a new version of the codes of chunks (id, content) below root, each file by id, with the range of ids of each file. Nothing is exchanged."""
    rows = encode(chunks.where("id IS NOT NULL").select("id", "content"), "content").select("id", "codes")
    segments.replace(rows.sortWithinPartitions("id"), root, "codes", "id", PAGES)
    files = segments.read(chunks.sparkSession, root, "codes").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    segments.replace(files, root, "codes_files")


def codes_of(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """id, codes of the chunks of ids (id). Of NAMED_IDS at most only the files and pages that may hold them are read; more are joined with the whole table."""
    table = segments.read(spark, root, "codes")
    named = sorted(r.id for r in ids.select("id").where("id IS NOT NULL").distinct().limit(NAMED_IDS + 1).collect())
    if not named:
        return table.limit(0)
    if len(named) > NAMED_IDS:
        return table.join(ids.select("id").distinct(), "id", "left_semi")
    wanted = F.array(*[F.lit(x) for x in named])
    files = segments.read(spark, root, "codes_files").where(F.exists(wanted, lambda x: x.between(F.col("lo"), F.col("hi")))).collect()  # files, not rows
    if not files:
        return table.limit(0)
    some = F.lit(False)
    for i in range(0, len(named), IN_VALUES):
        some = some | F.col("id").isin(named[i : i + IN_VALUES])
    return spark.read.schema(table.schema).parquet(*[f.file for f in files]).where(some)


def similarity(asked: Column, held: Column) -> Column:
    """The sum over the codes asked of the greatest similarity to a code that is held: between -SIGNS and SIGNS for each; 0 where either has none."""
    best = lambda q: F.array_max(F.transform(held, lambda d: F.lit(SIGNS) - 2 * F.bit_count(q.bitwiseXOR(d))))
    return F.coalesce(F.aggregate(asked, F.lit(0).cast("long"), lambda s, q: s + F.coalesce(best(q), F.lit(0))), F.lit(0).cast("long"))


def rerank(items: DataFrame, root: str, encode: Callable[[DataFrame, str], DataFrame] = coded) -> DataFrame:
    """items (query_id, query, id, place), a batch's candidates, with late: their similarity, and place anew: by late, then the place before.

    Chunks without stored codes, without tokens, and queries without tokens have 0. Only the candidates' codes are read.
    """
    named = items.select("query_id", "query", "id", "place")
    few = named.limit(NAMED_IDS + 1).toArrow()  # without texts; made once for the queries and the ids
    batch = items.sparkSession.createDataFrame(few, named.schema) if few.num_rows <= NAMED_IDS else named
    items = batch if set(items.columns) == set(named.columns) else items  # what has nothing else isn't made again
    queries = encode(batch.select("query_id", "query").distinct(), "query").select("query_id", F.col("codes").alias("_asked"))
    held = codes_of(items.sparkSession, root, batch).select("id", F.col("codes").alias("_held"))
    scored = items.join(held, "id", "left").join(queries, "query_id", "left").withColumn("late", similarity(F.col("_asked"), F.col("_held"))).drop("_asked", "_held")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("late"), "place", "id")))
