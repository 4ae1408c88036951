"""Sharding by jump consistent hashing: a stable key and the number of shards decide; one more shard takes rows only into itself. Column expressions alone.

A key's generator is the 64-bit linear congruential one that the method was published with, started at the first 64 bits of the SHA-256 of the key's text, so that
keys in any order or spacing spread alike. From shard b the key jumps to the next shard that it would have moved to, (b + 1) / r for a uniform r, until that lies
beyond the shards: about ln(shards) steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SENT, parts, pick, stored

#: The generator's factor, and 2 ** 31 that scales its upper bits to (0, 1].
FACTOR = 2862933555777941757
SCALE = 1 << 31

#: Steps in one round; a row that has ended skips the rounds that remain.
ROUND = 32

_LOW = (1 << 32) - 1


def seed(key: Column) -> Column:
    """The first 64 bits of the SHA-256 of a key's text, as a signed long; null counts as empty."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), 256), 1, 16), 16, -10).cast("long")


def _stepped(state: Column) -> Column:
    """state * FACTOR + 1 modulo 2 ** 64. Halves of 32 bits meet halves of the factor, themselves cut to 16 bits, so that no product leaves a long."""

    def wide(half: Column, factor: int) -> tuple[Column, Column]:  # half * factor (32 bits each): upper and lower 32 bits
        small, large = half * F.lit(factor & 0xFFFF), half * F.lit(factor >> 16)
        low = small + F.shiftleft(large.bitwiseAND(F.lit(0xFFFF)), 16)
        return F.shiftright(low, 32) + F.shiftright(large, 16), low.bitwiseAND(F.lit(_LOW))

    lower, upper = state.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(state, 32)
    carry, low = wide(lower, FACTOR & _LOW)
    low = low + F.lit(1)
    high = carry + F.shiftright(low, 32) + wide(lower, FACTOR >> 32)[1] + wide(upper, FACTOR & _LOW)[1]
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def jumps(key: Column, shards: int) -> Column:
    """A struct of shard (of so many) and grown (of one more): the last two places of the key's jumps that lie below."""
    if shards < 1:
        raise ValueError("there must be a shard at least")

    def step(s: Column, _: Column) -> Column:
        state = _stepped(s["state"])
        part = (F.shiftrightunsigned(state, 33) + 1).cast("double")
        to = F.floor((s["next"] + 1).cast("double") * (F.lit(float(SCALE)) / part)).cast("long")
        return F.when(s["next"] > shards, s).otherwise(F.struct(state.alias("state"), s["at"].alias("before"), s["next"].alias("at"), to.alias("next")))

    none = F.lit(-1).cast("long")
    start = F.struct(seed(key).alias("state"), none.alias("before"), none.alias("at"), F.lit(0).cast("long").alias("next"))
    most = shards + 2  # each step goes one shard further at least
    one = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step)
    if most <= ROUND:
        end = one(start, most)
    else:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(-(-most // ROUND))), start, lambda s, _: F.when(s["next"] > shards, s).otherwise(one(s, ROUND)))
    # an array of the one result binds it to a name, so that it is made once
    two = lambda s: F.struct(F.when(s["at"] < shards, s["at"]).otherwise(s["before"]).cast("int").alias("shard"), s["at"].cast("int").alias("grown"))
    return F.element_at(F.transform(F.array(end), two), 1)


def assigned(rows: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """rows with all columns as they are and, at the end, shard and grown_shard of their key."""
    held = rows.columns
    plain = rows.toDF(*[f"_c{i}" for i in range(len(held))])
    out = plain.withColumn("_to", jumps(F.col(f"_c{held.index(key)}"), shards))
    return out.select(*plain.columns, "_to.shard", "_to.grown").toDF(*held, "shard", "grown_shard")


def moves(rows: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """The rows that one more shard takes, all into itself: about one of shards + 1. All others stay where they are."""
    out = assigned(rows, shards, key)
    names = out.columns
    plain = out.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.where(F.col(f"_c{len(names) - 2}") != F.col(f"_c{len(names) - 1}")).toDF(*names)


def slots(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law `key`.

    The key is the doc_id alone, so equal texts lie together only where their ids do, and repeated ids always. size is the text's bytes and eight more. Null texts are
    empty, a null doc_id counts as an empty key. Slots go from 0 in each shard, by doc_id (null first), size and checksum; rows equal in these take theirs in any order.
    Other columns are not read; an empty table gives no rows.

    Texts are read once. The narrow rows are sorted by ranges of (shard, doc_id, size, checksum, place); the place, unique, lets a range end between repeated rows, so no
    id is too many for a task. Files hold whole ranges in order, so a row's slot is its place in the file, less that of the shard's first row there, and the shard's rows in files before:
    a number for each file and shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = stored(assigned(sized, shards).withColumn("place", F.monotonically_increasing_id()), "sharded")
    order = ["shard", "doc_id", "size", "text_crc32", "place"]
    ranged = stored(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("place"), "ranged")
    placed = ranged.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = placed.groupBy("file", "shard").agg(F.min("row").alias("first"), F.count("*").alias("many"), F.min(F.struct("doc_id", "size", "text_crc32")).alias("least"))
    first = stored(first, "firsts")
    before = Window.partitionBy("shard").orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1)
    start = first.select("file", "shard", (F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("first")).alias("start"))
    out = placed.join(F.broadcast(start) if first.count() <= SENT else start, ["file", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("row")).cast("long").alias("slot"), "grown_shard")


def written(docs: DataFrame, path: str, shards: int, key: str = "doc_id", most_rows: int = 1_000_000) -> DataFrame:
    """Writes docs to path as a folder shard=N for each shard, in files of at most most_rows rows, and returns the table read from there.

    An exchange gathers a shard's rows from all tasks, by the task they come from, so that a large shard is dealt over several. A column named shard may not be there already.
    """
    out = assigned(docs, shards, key)
    out = out.select(*out.columns[:-1]).withColumn("_from", F.pmod(F.spark_partition_id(), F.lit(max(1, parts(docs) // shards))))
    out.repartition("shard", "_from").drop("_from").write.option("maxRecordsPerFile", most_rows).partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
