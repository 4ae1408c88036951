"""Index tables kept as segments: rows and tombstones that are written once, and a manifest that names those that count.

root/name/segments/<id>/rows and .../gone are Parquet; root/name/manifest/<version>.json is the table at a version. A writer writes its segment first and then makes the
next manifest, which must not be there yet: readers see the old version or the new one, and a failure in between leaves the old one. One writer at a time is
meant; of two that meet, one gets an error. Versions grow by one and are never overwritten.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of tombstones that may be broadcast.
SENT = 1 << 18
#: Segments from which on a table is compacted by apply().
COMPACT_AT = 8


class VersionError(RuntimeError):
    """Another writer made this version first."""


@dataclass
class Manifest:
    """segments: (id, schema as JSON, rows, tombstones) from the oldest on. batches: the last batch number that each stream has committed."""

    version: int = 0
    key: str | None = None
    segments: list[list] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Versions whose manifests are there, from the oldest on."""
    fs, at = _files(spark, f"{root}/{name}/manifest")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []


def manifest(spark: SparkSession, root: str, name: str, version: int | None = None) -> Manifest:
    """The table's last complete version, or the one asked for; version 0 without segments where there is none. A manifest that a writer never finished doesn't count."""
    for v in [version] if version is not None else reversed(versions(spark, root, name)):
        fs, at = _files(spark, f"{root}/{name}/manifest/{v:012d}.json")
        stream = fs.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest(**json.loads(text))
        except ValueError:
            continue
    return Manifest()


def _commit(spark: SparkSession, root: str, name: str, m: Manifest) -> Manifest:
    taken = max([m.version, *versions(spark, root, name)])
    if taken > m.version and manifest(spark, root, name).version > m.version:
        raise VersionError(f"{name} is at version {taken} already, not {m.version}")
    m.version = taken + 1
    fs, at = _files(spark, f"{root}/{name}/manifest/{m.version:012d}.json")
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise VersionError(f"version {m.version} of {name} is there already") from e
    out.write(bytearray(json.dumps(vars(m)).encode()))
    out.close()
    return m


def _written(df: DataFrame, path: str, options: dict[str, str] | None = None) -> int:
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def _segment(root: str, name: str, rows: DataFrame | None, gone: DataFrame | None, options: dict[str, str] | None = None) -> list:
    """Writes a segment and says what it holds."""
    number = uuid.uuid4().hex
    path = f"{root}/{name}/segments/{number}"
    dead = _written(gone, f"{path}/gone") if gone is not None else 0
    return [number, rows.schema.json() if rows is not None else None, _written(rows, f"{path}/rows", options) if rows is not None else 0, dead]


def replace(df: DataFrame, root: str, name: str, key: str | None = None, options: dict[str, str] | None = None) -> Manifest:
    """A new version that has df's rows alone, written with these options."""
    old = manifest(df.sparkSession, root, name)
    return _commit(df.sparkSession, root, name, Manifest(old.version, key or old.key, [_segment(root, name, df, None, options)], old.batches))


def replace_by(tables: list[tuple[DataFrame, dict[str, str]]], root: str, name: str) -> Manifest:
    """As replace(), with the rows of several tables, each written with its own options as a segment."""
    spark = tables[0][0].sparkSession
    old = manifest(spark, root, name)
    return _commit(spark, root, name, Manifest(old.version, old.key, [_segment(root, name, df, None, options) for df, options in tables], old.batches))


@contextmanager
def staged(df: DataFrame, root: str):
    """df written below root, to be read several times, and dropped at the end."""
    path = f"{root}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _drop(df.sparkSession, path)


def apply(changes: DataFrame, root: str, name: str, key: str = "id", deleted: str | None = None, order: str | None = None, batch: tuple[str, int] | None = None, compact_at: int = COMPACT_AT) -> Manifest:
    """A new version in which the rows of changes' keys are replaced by changes' rows, and gone where the Boolean column deleted says so.

    Of rows with the same key that with the largest order counts, or else the first as JSON; null keys take no part. batch names a stream and a batch's number: one that is committed
    already changes nothing. A table of compact_at segments is rewritten as one. Other rows aren't read or written.
    """
    spark = changes.sparkSession
    m = manifest(spark, root, name)
    if batch and batch[1] <= m.batches.get(batch[0], -1):
        return m
    if m.key not in (None, key):
        raise ValueError(f"{name} is kept by {m.key}, not by {key}")
    row = F.struct(*[F.col(c) for c in changes.columns])
    last = F.max_by(row, F.struct(order, F.to_json(row))) if order else F.min_by(row, F.to_json(row))
    new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_row")).select("_row.*")
    drop = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    number = uuid.uuid4().hex
    path = f"{root}/{name}/segments/{number}"
    new.withColumn("_gone", drop).write.parquet(f"{path}/changes")  # evaluated once: rows and tombstones must agree
    held = spark.read.parquet(f"{path}/changes")
    rows = held.where("NOT _gone").drop("_gone", *([deleted] if deleted else []))
    segment = _segment(root, name, rows, held.select(key))
    m = _commit(spark, root, name, Manifest(m.version, key, [*m.segments, segment], m.batches | ({batch[0]: batch[1]} if batch else {})))
    _drop(spark, path)
    return compact(spark, root, name) if len(m.segments) >= compact_at else m


def delete(keys: DataFrame, root: str, name: str, key: str = "id") -> Manifest:
    """A new version without the rows of these keys: tombstones alone are written."""
    spark, m = keys.sparkSession, manifest(keys.sparkSession, root, name)
    gone = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return _commit(spark, root, name, Manifest(m.version, key, [*m.segments, _segment(root, name, None, gone)], m.batches))


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The table's rows: each segment's but those whose keys a later one has among its tombstones. Columns that some segments lack are null in their rows."""
    m = manifest(spark, root, name, version)
    if not m.segments:
        raise FileNotFoundError(f"PATH_NOT_FOUND: no version of {root}/{name}")
    from pyspark.sql.types import StructType

    kept, gone, dead = None, None, 0
    for i, (number, schema, many, tombs) in enumerate(m.segments):
        path = f"{root}/{name}/segments/{number}"
        if tombs and i:
            of = spark.read.parquet(f"{path}/gone").select(F.col(m.key).alias("_key"), F.lit(i).alias("_by"))
            gone, dead = of if gone is None else gone.unionByName(of), dead + tombs
        if schema is not None:
            rows = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/rows").withColumn("_at", F.lit(i))
            kept = rows if kept is None else kept.unionByName(rows, allowMissingColumns=True)
    if kept is None:
        raise FileNotFoundError(f"PATH_NOT_FOUND: no rows of {root}/{name}")
    if gone is not None:
        gone = gone.groupBy("_key").agg(F.max("_by").alias("_by"))
        hit = (F.col(m.key) == F.col("_key")) & (F.col("_at") < F.col("_by"))
        kept = kept.join(F.broadcast(gone) if dead <= SENT else gone, hit, "left_anti")
    return kept.drop("_at")


def compact(spark: SparkSession, root: str, name: str) -> Manifest:
    """A new version with the same rows in one segment."""
    m = manifest(spark, root, name)
    rows = read(spark, root, name)
    return _commit(spark, root, name, Manifest(m.version, m.key, [_segment(root, name, rows, None)], m.batches))


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Deletes manifests but the last ones, and segments that none of those names; readers of older versions fail then. Returns how many segments went."""
    last = versions(spark, root, name)
    named = {s[0] for v in last[-keep:] for s in manifest(spark, root, name, v).segments}
    fs, at = _files(spark, f"{root}/{name}/segments")
    lost = [f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName() not in named]
    for v in last[:-keep]:
        _drop(spark, f"{root}/{name}/manifest/{v:012d}.json")
    for number in lost:
        _drop(spark, f"{root}/{name}/segments/{number}")
    return len(lost)


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)
