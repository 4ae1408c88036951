"""Cleaning and packing a corpus: each stage applies one operator to what the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs, in their order, extra ones included.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.llm import exact_dedup, jaccard, packing, quality, suffix_dedup
from loregrid.llm.common import pick, sent, stored

#: Fixed columns of the stages' own, beside those of docs, which are renamed to _c0, _c1, ...
_ID, _BODY = "_id", "_body"
#: Bytes from which on a repeated string is a passage: fewer than those of nearly all runs of over fifty words of prose.
PASSAGE_BYTES = 240


def _learns(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 != 1


def _plain(docs: DataFrame) -> DataFrame:
    """docs with its columns renamed by position, _id (doc_id) and _body (text, null as empty): no name of an extra column can clash."""
    held = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(held))])
    return plain.withColumns({_ID: F.col(f"_c{held.index('doc_id')}").cast("long"), _BODY: F.coalesce(F.col(f"_c{held.index('text')}").cast("string"), F.lit(""))})


def _back(plain: DataFrame, docs: DataFrame) -> DataFrame:
    return plain.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _without(plain: DataFrame, gone: DataFrame, keys: dict) -> DataFrame:
    """plain without the rows of gone (stored). keys: expressions over plain's columns by the names of gone's columns."""
    gone = sent(gone).select(*[F.col(name).alias(f"_g{i}") for i, name in enumerate(keys)])
    same = [e.eqNullSafe(F.col(f"_g{i}")) for i, e in enumerate(keys.values())]
    return plain.join(gone, same, "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good (score of 0.5 or more). It learns from the labels of documents at hand whose id's crc32 mod 3 isn't 1.

    A null text counts as empty. Rows that repeat are judged each; an empty table gives no rows; extra columns stay, whatever their names.
    """
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learns=_learns)
    found = quality.scored(docs, trees).toDF(*[f"_c{i}" for i in range(len(docs.columns))], "_p")
    return _back(found.where("_p >= 0.5"), docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest, then that with the smallest doc_id; a null doc_id comes last.

    Of rows that tie in both, that whose columns come first as JSON stays. Null texts count as empty, and empty ones equal each other. An empty table gives
    no rows; extra columns stay, whatever their names.
    """
    rows = stored(exact_dedup.exact_owners(docs).select("doc_id", "content_hash", "kept"), "owners")
    plain = _plain(docs)
    keys = {"doc_id": F.col(_ID), "content_hash": F.unhex(F.sha2(F.translate(_BODY, exact_dedup.WHITE, "").cast("binary"), 256))}
    gone = stored(rows.where(~F.col("kept")).select("doc_id", "content_hash").distinct(), "gone")
    out = _without(plain, gone, keys)
    again = stored(rows.where("kept").groupBy("doc_id", "content_hash").count().where("count > 1").select("doc_id", "content_hash"), "again")
    if again.isEmpty():
        return _back(out, docs)
    tied = out.withColumn("_hash", keys["content_hash"])
    tied = tied.join(sent(again), tied[_ID].eqNullSafe(again.doc_id) & (tied._hash == again.content_hash), "left_semi")
    row = F.struct(*[f"_c{i}" for i in range(len(docs.columns))])
    first = tied.groupBy(_ID, "_hash").agg(F.min_by(row, F.struct(-F.length(_BODY), F.to_json(row))).alias("_row")).select("_row.*")
    return _back(_without(out, again, keys), docs).unionByName(_back(first, docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that near-duplicate links connect.

    Rows that repeat a doc_id with other texts are documents of their own, and come after those whose doc_id stands once; rows that repeat a doc_id and a text
    share their verdict. Rows with a null doc_id, a null or an empty text stay. An empty table gives no rows; extra columns stay, whatever their names.
    """
    plain = _plain(docs)
    again = stored(plain.where("_id IS NOT NULL").groupBy(F.col(_ID).alias("_again")).count().where("count > 1").select("_again"), "again")
    if not again.isEmpty():  # beyond all usual ids
        own = F.lit(1 << 62) + F.xxhash64(_ID, _BODY).bitwiseAND(F.lit((1 << 61) - 1))
        plain = plain.join(sent(again), F.col(_ID) == F.col("_again"), "left").withColumn(_ID, F.when(F.col("_again").isNotNull(), own).otherwise(F.col(_ID))).drop("_again")
    found = jaccard.clusters(plain.select(F.col(_ID).alias("doc_id"), F.col(_BODY).alias("text")))
    gone = stored(found.where("component_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct(), "near")
    return _back(_without(plain, gone, {"doc_id": F.col(_ID)}), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every byte of repeated strings of PASSAGE_BYTES bytes removed from their texts (and characters that a removed run cuts into).

    Texts without such bytes stay as they are, null ones too; n_chars, where there is such a column, is counted anew for the others. Rows that repeat are
    copies of each other like any others. An empty table gives no rows; extra columns stay, whatever their names.
    """
    rows = suffix_dedup.removed(docs, PASSAGE_BYTES, whole_characters=True)
    names = docs.columns
    plain = rows.toDF(*[f"_c{i}" for i in range(len(names))], "_cut")
    text = f"_c{names.index('text')}"
    new = F.when(F.size("_cut.spans") > 0, F.col("_cut.kept").cast("string")).otherwise(F.col(text))
    plain = plain.withColumn(text, new)
    if "n_chars" in names:
        size = f"_c{names.index('n_chars')}"
        plain = plain.withColumn(size, F.when(F.size("_cut.spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)))
    return plain.drop("_cut").toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 tokens; ids are little-endian unsigned 32-bit numbers.

    A null or empty text is the end token alone. Rows that repeat are packed each; an empty table gives no rows; extra columns are not read.
    """
    return packing.pack(pick(docs, "doc_id", "text"), tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("jaccard", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can't express the classifier, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
