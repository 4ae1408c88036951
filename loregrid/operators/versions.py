"""Versions as sortable keys, and requirements as half-open intervals of them: which versions meet which requirements, by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knowledge import version_parts

#: Digits of a part in a key: any 32-bit number.
DIGITS = 10
_LAST = "~"  # sorts behind every key


def _key(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.lpad(p.cast("string"), DIGITS, "0")), ".")


def version_key(version: Column) -> Column:
    """Text that sorts as the version's major, minor and patch numbers do."""
    return _key(version_parts(version).cast("array<bigint>"))


def interval(requirement: Column) -> Column:
    """struct<lo, hi, first, last>: keys from lo on and below hi meet the requirement, and major numbers from first to last (null: without end); as knowledge.satisfies() has it."""
    sign = F.regexp_extract(requirement, r"^(>=|<=|>|<|=|~|\^)?", 1)
    need = version_parts(requirement).cast("array<bigint>")
    major, minor, patch = need[0], need[1], need[2]
    at, behind = _key(need), _key(F.array(major, minor, patch + 1))
    lo = F.when(sign.isin("<", "<="), F.lit("")).when(sign == ">", behind).otherwise(at)
    hi = (
        F.when(sign == "<", at).when(sign.isin("<=", "="), behind).when(sign == "~", _key(F.array(major, minor + 1, F.lit(0).cast("bigint"))))
        .when(sign == "^", _key(F.array(major + 1, F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))).otherwise(F.lit(_LAST))
    )
    first, last = F.when(sign.isin("<", "<="), F.lit(0).cast("bigint")).otherwise(major), F.when(~sign.isin(">", ">=", ""), major)
    return F.when(requirement.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), first.alias("first"), last.alias("last")))


def matching(versions: DataFrame, requirements: DataFrame, name: str = "name", version: str = "version", requirement: str = "requirement") -> DataFrame:
    """Rows of versions and requirements of the same name whose version meets the requirement: all columns of both, the name once; other names that they share are an error.

    Distinct versions meet distinct requirements first, each once for a name: a requirement's interval is cut along the major numbers that its name's versions have, names and major numbers meet by
    equality, and only versions at an interval's ends are told apart by their keys. Rows then join by their version's and requirement's texts, so what is left to do is as much as there are rows to
    give; they are dealt by version over all of the session's partitions, as few rows may give many. Null names, versions and requirements meet nothing.
    """
    if clash := set(versions.columns) & set(requirements.columns) - {name}:
        raise ValueError(f"both tables have {sorted(clash)}")
    v = versions.where(F.col(version).isNotNull()).withColumn("_key", version_key(F.col(version)))
    held = v.select(name, "_key", version_parts(F.col(version))[0].cast("bigint").alias("_major")).distinct()
    asked = requirements.select(name, requirement).distinct().withColumn("_in", interval(F.col(requirement))).where("_in IS NOT NULL")
    cut = asked.join(held.select(name, "_major").distinct(), name).where("_major >= _in.first AND (_in.last IS NULL OR _major <= _in.last)")
    met = cut.join(held, [name, "_major"]).where("_key >= _in.lo AND _key < _in.hi").select(name, requirement, "_key")
    wanted = requirements.join(met, [name, requirement])
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = wanted.repartition(parts, name, "_key").join(v.repartition(parts, name, "_key"), [name, "_key"])
    return both.select(name, *[c for c in versions.columns if c != name], *[c for c in requirements.columns if c != name])
