"""The corpus as chunks, from tables or from files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER_VERSION, chunk_id, pipeline_tokens
from ..schemas import TYPES
from . import segments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(docs: DataFrame) -> DataFrame:
    """Chunks of a documents table: the type goes round by doc_id, the module is the source."""
    kinds = F.array(*[F.lit(t) for t in TYPES])
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int")).alias("type"),
        text.alias("content"),
        F.concat_ws(" ", F.col("lang"), F.lit("note"), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("module"),
        F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_path"),
        pipeline_tokens(text).alias("tokens"),
        F.to_json(F.struct(F.col("source").alias("source"), F.col("lang").alias("sdk"))).alias("meta_json"),
    )


def load_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("md", "py", "go")) -> DataFrame:
    """path (relative), filename, content of files below root; files that aren't UTF-8 are left out."""
    pattern = "*.{%s}" % ",".join(suffixes) if len(suffixes) > 1 else f"*.{suffixes[0]}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    path = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    return raw.where(F.expr("is_valid_utf8(content)")).select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("filename"), F.col("content").cast("string").alias("content"))


def api_chunks(files: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Chunks of files (path, content) that hold a JSON array of API entries, one chunk each. fields: the entries' names of title, method, path and description.

    What isn't an array of objects gives no rows, nor do entries without a title and a path.
    """
    names = {"title": "name", "method": "method", "path": "path", "description": "description"} | (fields or {})
    entries = files.select(F.col("path").alias("source_path"), F.posexplode(F.from_json("content", "ARRAY<MAP<STRING, STRING>>")).alias("n", "e"))
    got = {k: F.coalesce(F.try_element_at("e", F.lit(v)), F.lit("")) for k, v in names.items()}
    rows = entries.select("source_path", "n", *[c.alias(f"_{k}") for k, c in got.items()]).where("_title <> '' OR _path <> ''")
    text = F.concat_ws("\n", F.nullif(F.concat_ws(" ", F.upper("_method"), "_path"), F.lit(" ")), F.nullif("_description", F.lit("")))
    meta = F.to_json(F.struct(F.lit("doc").alias("knowledge_source"), F.lit("rest").alias("api_type"), F.upper("_method").alias("http_method"), F.col("_path").alias("url_path")))
    module = F.when(F.contains("source_path", F.lit("/")), F.split("source_path", "/")[0]).otherwise("")
    return rows.select(
        chunk_id(F.col("source_path"), F.col("n").cast("string")).alias("id"), F.lit("api").alias("type"), text.alias("content"), F.coalesce(F.nullif("_title", F.lit("")), "_path").alias("title"),
        module.alias("module"), "source_path", pipeline_tokens(text).alias("tokens"), meta.alias("meta_json"))


def poms(files: DataFrame) -> DataFrame:
    """group_id, artifact_id, version, pom_dir, depth of pom.xml files; group and version fall back to the parent's. Without an artifact there is no row."""
    x = F.from_xml("content", F.lit("artifactId STRING, groupId STRING, version STRING, parent STRUCT<groupId: STRING, version: STRING>"))
    p = files.where("filename = 'pom.xml'").select("path", x.alias("x"))
    return p.select(
        F.coalesce("x.groupId", "x.parent.groupId").alias("group_id"),
        F.col("x.artifactId").alias("artifact_id"),
        F.coalesce("x.version", "x.parent.version", F.lit("")).alias("version"),
        F.regexp_replace("path", "/?pom\\.xml$", "").alias("pom_dir"),
        F.size(F.split("path", "/")).alias("depth"),
    ).where("artifact_id IS NOT NULL")


def version_overrides(files: DataFrame, name: str = ".sdk-versions.json") -> DataFrame:
    """artifact_id, override of an override file; what isn't an object gives no rows."""
    return files.where(F.col("filename") == name).select(F.explode(F.from_json("content", "MAP<STRING, STRING>")).alias("artifact_id", "override"))


def resolved_versions(modules: DataFrame, overrides: DataFrame) -> DataFrame:
    """modules with resolved: the override, else the literal version unless it is a placeholder, else that of the nearest module above with one, else ''."""
    own = modules.join(F.broadcast(overrides), "artifact_id", "left")
    own = own.withColumn("own", F.coalesce("override", F.when(~F.col("version").rlike(PLACEHOLDER_VERSION), F.col("version"))))
    above = own.where("own IS NOT NULL").select(F.col("pom_dir").alias("_dir"), F.col("own").alias("_version"), F.col("depth").alias("_depth"))
    below = (F.col("_dir") == "") | F.startswith(F.concat("pom_dir", F.lit("/")), F.concat("_dir", F.lit("/")))
    best = own.select("artifact_id", "pom_dir").join(above, below).groupBy("artifact_id", "pom_dir").agg(F.max_by("_version", "_depth").alias("_near"))
    return own.join(best, ["artifact_id", "pom_dir"], "left").withColumn("resolved", F.coalesce("own", "_near", F.lit(""))).drop("own", "_near", "override")


def write_index(df: DataFrame, root: str, name: str, key: str | None = None) -> int:
    """Writes a new version of an index table, which has df's rows alone, and returns its number; readers see the version before until it is complete."""
    return segments.replace(df, root, name, key).version


def current_index(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The last complete version of an index table."""
    return segments.read(spark, root, name)
