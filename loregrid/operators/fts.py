"""Full-text retrieval: tokens, postings and BM25 over texts. match.py has the match grammar, fts_index.py the stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import gathered, small_batches, starts
from ..functions.text import ACCENTED, PLAIN, tokens

# The ranking function's constants.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def terms(text: Column) -> Column:
    """The index's tokens: lower-cased runs of letters and numbers, without accents; text and queries alike."""
    return tokens(text, fold_accents=True)


def terms_joined(text: Column) -> Column:
    """terms() with a space between them."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+", " "))


_FOLD = {ord(c): PLAIN[i] if i < len(PLAIN) else None for i, c in enumerate(ACCENTED)}


def split(word: str) -> list[str]:
    """As terms() of a query's word, which may be none or several tokens."""
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", word.lower().translate(_FOLD)) if t]


#: Bytes of tokens whose postings a task makes at a time, and postings that it gives at a time.
RUN_BYTES, GIVEN_ROWS = 4 << 20, 20_000


def _postings_of(columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of doc_id and the columns' joined tokens to postings: a chunk's tokens are sorted in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, RUN_BYTES):
            ids = rows.column("doc_id").combine_chunks()
            for name in columns:
                text = rows.column(name).combine_chunks()
                words = pc.split_pattern(pc.if_else(pc.equal(text, ""), None, text), " ")
                sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = words.flatten().dictionary_encode()
                code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = np.lexsort((code, row))  # positions stay in order
                key = (row * len(coded.dictionary) + code)[order]
                at = starts(key)
                ends = np.append(at, len(key)).astype(np.int32)
                first = order[at]
                found = {"term": coded.dictionary.take(pa.array(code[first])), "doc_id": ids.take(pa.array(row[first])), "col": pa.array([name] * len(at), pa.string())}
                found |= {"tf": pa.array(np.diff(ends)), "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order], pa.int32()))}
                out = pa.RecordBatch.from_pydict(found)
                for i in range(0, out.num_rows, GIVEN_ROWS):
                    yield out.slice(i, GIVEN_ROWS)

    return run


def postings(chunks: DataFrame, columns: tuple[str, ...] = ("content",), key: str = "id") -> DataFrame:
    """term, doc_id, col, tf, positions of every token of the columns.

    A chunk's task makes its postings. Only keys are exchanged, to tell those that several chunks have; these chunks' tokens alone meet by key and term.
    """
    small_batches(chunks.sparkSession)
    shared = chunks.groupBy(F.col(key).alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    given, whole, same = chunks, None, F.col(key).eqNullSafe(F.col("_shared"))
    if not shared.isEmpty():
        given, whole = chunks.join(shared, same, "left_anti"), chunks.join(shared, same, "left_semi")
    kind = given.schema[key].dataType.simpleString()
    joined = given.select(F.col(key).alias("doc_id"), *[terms_joined(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])
    made = joined.mapInArrow(_postings_of(columns), f"term string, doc_id {kind}, col string, tf int, positions array<int>")
    if whole is None:
        return made
    parts = F.array(*[F.struct(F.lit(c).alias("col"), terms(F.coalesce(F.col(c), F.lit(""))).alias("t")) for c in columns])
    each = whole.select(F.col(key).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.col", F.posexplode("p.t").alias("pos", "term"))
    return made.unionByName(each.groupBy("term", "doc_id", "col").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")))


def lexicon(chunks: DataFrame, column: str = "content") -> DataFrame:
    """term, df, cf: in how many chunks and how often each token stands. A token's first place in its chunk counts for df, so one exchange is enough."""
    # an array of the sorted tokens binds them to a name, so they are made once
    first = F.flatten(F.transform(F.array(F.array_sort(terms(F.col(column)))), lambda t: F.transform(t, lambda w, i: F.struct(w.alias("term"), ((i == 0) | (F.get(t, i - 1) != w)).cast("long").alias("first")))))
    return chunks.select(F.explode(first).alias("p")).groupBy("p.term").agg(F.sum("p.first").alias("df"), F.count("*").alias("cf"))


def corpus_stats(chunks: DataFrame, column: str = "content") -> DataFrame:
    n = chunks.select(F.size(terms(F.col(column))).cast("long").alias("dl"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_tokens"), F.round(F.avg("dl"), 4).alias("avgdl"))


# ---------------------------------------------------------------- ranking


def bm25(chunks: DataFrame, queries: DataFrame, mode: str = "ranked", k: int = 30, types: list[str] | None = None, module: str | None = None) -> DataFrame:
    """query_id, id, raw, score, rank: the k best chunks of each query (query_id, query).

    ranked: all columns weigh 1, score = 1 / (1 + exp(raw)) with raw <= 0, so better is higher. compat: only module and meta_json weigh, and
    score = 1 / (1 + exp(-raw)). lucene: the better of content and title, each by itself; score is the raw sum. A query's tokens each add their share; chunks
    are joined on the tokens that queries have, so only those postings are made. types and module keep only chunks of those, before the k are chosen; scores
    are those of all chunks.
    """
    columns = ("content", "title") if mode == "lucene" else ("title", "content", "module", "meta_json") if mode == "compat" else ("title", "content", "module")
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).distinct()
    parts = F.array(*[F.struct(F.lit(c).alias("col"), terms(F.coalesce(F.col(c), F.lit(""))).alias("t")) for c in columns])
    whole = chunks.select("id", parts.alias("parts")).withColumn("all", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["t"])))
    per = ["col"] if mode == "lucene" else []
    text = whole.select("id", "all", F.explode("parts").alias("p")).select("id", "p.col", "p.t", (F.size("p.t") if per else F.col("all")).alias("dl"))
    # lengths travel with the hits, so nothing is joined by chunk; only the batch's tokens leave a task
    stats = text.groupBy("col").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")) if per else whole.agg(F.count("*").alias("n"), F.avg("all").alias("avgdl"))
    weight = F.when(F.col("col").isin("module", "meta_json"), 1).otherwise(0) if mode == "compat" else F.lit(1)
    hits = text.select("id", "col", "dl", F.explode("t").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term")
    tf = hits.groupBy("id", "term", "dl", *per).agg(F.sum(weight).cast("double").alias("tf"))
    df = tf.groupBy("term", *per).agg(F.count("*").alias("df"))
    return _ranked(tf, asked, df, stats, mode, k, kept_ids(chunks, types, module))


def kept_ids(chunks: DataFrame, types: list[str] | None, module: str | None) -> DataFrame | None:
    """The ids that the filters keep; None without filters."""
    if not types and not module:
        return None
    kept = chunks.where(F.col("type").isin(types)) if types else chunks
    return (kept.where(F.col("module") == module) if module else kept).select("id")


def idf_of(n: Column, df: Column, mode: str = "ranked") -> Column:
    odds = (n - df + 0.5) / (df + 0.5)
    return F.log1p(odds) if mode == "lucene" else F.when(F.log(odds) > 0, F.log(odds)).otherwise(LEAST_IDF)


def share_of(tf: Column, dl: Column, avgdl: Column, mode: str = "ranked") -> Column:
    """What a term's frequency adds to a score, before its idf; it grows with tf and falls with dl."""
    return tf / (tf + K1 * (1 - B + B * dl / avgdl)) * (1.0 if mode == "lucene" else K1 + 1)


def score_of(s: Column, mode: str = "ranked") -> Column:
    return F.round(1 / (1 + F.exp((-1 if mode == "compat" else 1) * s)), 4).alias("score")


def _ranked(tf: DataFrame, asked: DataFrame, df: DataFrame, stats: DataFrame, mode: str, k: int, kept: DataFrame | None) -> DataFrame:
    """bm25()'s rows from tf (id, term, dl, tf, with col in lucene mode), df of the batch's terms, and the corpus' figures."""
    per = ["col"] if mode == "lucene" else []
    x = tf.join(F.broadcast(df), ["term", *per])
    x = x.join(F.broadcast(stats), per) if per else x.crossJoin(F.broadcast(stats))  # one row
    share = idf_of(F.col("n"), F.col("df"), mode) * share_of(F.col("tf"), F.col("dl"), F.col("avgdl"), mode)
    x = x.withColumn("share", share).join(F.broadcast(asked), "term")
    if mode == "lucene":
        x = x.groupBy("query_id", "id", "col").agg(F.sum("share").alias("s")).groupBy("query_id", "id").agg(F.max("s").alias("s"))
        x = x.select("query_id", "id", F.round("s", 4).alias("raw"), F.round("s", 4).alias("score"))
    else:
        x = x.groupBy("query_id", "id").agg((-F.sum("share")).alias("s"))
        x = x.select("query_id", "id", F.round("s", 4).alias("raw"), score_of(F.col("s"), mode))
    if kept is not None:
        x = x.join(kept, "id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc() if mode == "lucene" else F.col("raw"), "id")
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
