"""The knowledge base: entities, specifications, recommendations, feedback, audit and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ACTIONS


def entity(entities: DataFrame, names: DataFrame, kind: str | None = None, requirement: str | None = None) -> DataFrame:
    """query_id, asked, found and the entity: that with the name as it is, else the first whatever the case. requirement: entities' since_version must meet it."""
    e = entities.where(F.col("entity_type") == kind) if kind else entities
    e = e.where(satisfies(F.col("since_version"), F.lit(requirement))) if requirement else e
    hit = names.join(e, F.lower("asked") == F.lower("name"), "left")
    order = Window.partitionBy("query_id").orderBy((F.col("asked") == F.col("name")).desc_nulls_last(), "name", "entity_id")
    return hit.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").withColumn("found", F.col("name").isNotNull())


def version_parts(version: Column) -> Column:
    """Major, minor and patch as numbers."""
    return F.transform(F.slice(F.split(F.concat(F.regexp_replace(version, r"^[^0-9]*", ""), F.lit(".0.0")), r"\."), 1, 3), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def satisfies(version: Column, requirement: Column) -> Column:
    """Whether a version meets a requirement such as >=1.2, <2, =1.0.3, ~1.2 (same minor) or ^1.2 (same major); a bare version means at least."""
    sign, have, need = F.regexp_extract(requirement, r"^(>=|<=|>|<|=|~|\^)?", 1), version_parts(version), version_parts(requirement)
    at_least = have >= need
    return (
        F.when(sign.isin(">=", ""), at_least).when(sign == ">", have > need).when(sign == "<=", have <= need).when(sign == "<", have < need).when(sign == "=", have == need)
        .when(sign == "~", at_least & (F.slice(have, 1, 2) == F.slice(need, 1, 2))).otherwise(at_least & (have[0] == need[0]))
    )


def specs_for(specs: DataFrame, module: str | None = None, file_path: str | None = None, dependencies: dict[str, str] | None = None) -> DataFrame:
    """The specs that hold for a module, a file (specs' path_prefix is the beginning of its path) and a project's dependencies (name to version).

    A spec's requires (map of name to requirement) must be met by those of the dependencies that it names; a null prefix or map asks for nothing.
    """
    out = specs.where(F.col("module") == module) if module else specs
    if file_path:
        out = out.where(F.col("path_prefix").isNull() | F.startswith(F.lit(file_path), F.col("path_prefix")))
    for name, version in (dependencies or {}).items():
        need = F.try_element_at("requires", F.lit(name))
        out = out.where(need.isNull() | satisfies(F.lit(version), need))
    return out


def spec_conflicts(specs: DataFrame) -> DataFrame:
    """id, conflict_id: pairs of specs of a module of which one names the other, each once: ids that are whole numbers by number, others after them by text."""
    named = specs.select("module", F.col("id").alias("a"), F.explode("conflicts").alias("b"))
    both = named.join(specs.select("module", F.col("id").alias("b")), ["module", "b"])
    order = lambda c: F.struct(F.coalesce(F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("decimal(38, 0)")), F.lit("9" * 38).cast("decimal(38, 0)")).alias("n"), F.col(c).alias("id"))
    return both.select(F.least(order("a"), order("b"))["id"].alias("id"), F.greatest(order("a"), order("b"))["id"].alias("conflict_id")).distinct()


def recommended(usage: DataFrame, most: int = 5) -> DataFrame:
    """module, api, uses, rank: the most used APIs of each module (module, api, uses)."""
    order = Window.partitionBy("module").orderBy(F.desc("uses"), "api")
    return usage.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def feedback_rows(sessions: DataFrame) -> DataFrame:
    """feedback_id, session_id, knowledge_id, action: a row for each knowledge id that a session consumed; with modification_detail (JSON) where sessions have it."""
    key = F.concat(F.lit("fb_"), F.substring(F.md5(F.concat_ws("|", "session_id", F.array_join("consumed_knowledge_ids", ","), "action").cast("binary")), 1, 8))
    return sessions.select(key.alias("feedback_id"), "session_id", F.explode("consumed_knowledge_ids").alias("knowledge_id"), "action", *[c for c in sessions.columns if c == "modification_detail"])


def record_feedback(sessions: DataFrame, path: str) -> DataFrame:
    """Appends sessions' rows to the feedback table at path, and returns them."""
    rows = feedback_rows(sessions)
    rows.write.mode("append").parquet(path)
    return rows


def record_audit(log: DataFrame, session: str, path: str) -> DataFrame:
    """Appends a sanitization log's events to the audit table at path, and returns them."""
    rows = audit(log, session)
    rows.write.mode("append").parquet(path)
    return rows


def feedback_weights(rows: DataFrame, key: str = "knowledge_id") -> DataFrame:
    """key, a count for each action, and weight: (accepted + modified / 2 - rejected + 1) / (all + 2)."""
    counts = rows.groupBy(key).agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS], F.count("*").alias("total"))
    return counts.withColumn("weight", F.round((F.col("accepted") + F.col("modified") / 2 - F.col("rejected") + 1) / (F.col("total") + 2), 4))


def acceptance(rows: DataFrame, *keys: str) -> DataFrame:
    """n, accepted and the share accepted, by the keys and overall (keys null)."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "accepted").alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("n"), 4))


def paired_test(scores: DataFrame) -> DataFrame:
    """scenario, n, mean_difference, t, effect of paired scores (scenario, a, b), by scenario and overall."""
    d = scores.select("scenario", (F.col("a") - F.col("b")).alias("d"))
    x = d.rollup("scenario").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return x.select("scenario", "n", F.round("mean", 4).alias("mean_difference"), F.round(F.col("mean") / (F.col("sd") / F.sqrt("n")), 4).alias("t"), F.round(F.col("mean") / F.col("sd"), 4).alias("effect"))


def audit(log: DataFrame, session: str) -> DataFrame:
    """Security events of a sanitization log."""
    key = F.concat(F.lit("sec_"), F.substring(F.md5(F.concat_ws(":", F.lit(session), "item_id", "original_hash").cast("binary")), 1, 12))
    return log.select(key.alias("event_id"), F.lit("jailbreak_pattern_detected").alias("event_type"), F.lit("HIGH").alias("severity"), "item_id", "action", F.lit(session).alias("session_id"))


def health(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """status: ok if every table of paths can be read, degraded if some can, else down."""

    def works(path: str) -> bool:
        try:
            spark.read.parquet(path).limit(1).count()
            return True
        except Exception:  # whatever keeps it from being read
            return False

    up = spark.createDataFrame([(n, works(p)) for n, p in tables.items()], "name string, up boolean")
    return up.agg(F.when(F.bool_and("up"), "ok").when(F.bool_or("up"), "degraded").otherwise("down").alias("status"), F.map_from_entries(F.collect_list(F.struct("name", "up"))).alias("tables"))
