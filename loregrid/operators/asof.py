"""As-of joins of tables: each row with the nearest one before it, or after it, of the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ticks(time: Column, kind: str) -> Column:
    """A time as a number that grows with it: microseconds, days, or the number itself."""
    if kind.startswith("timestamp"):
        return F.unix_micros(time.cast("timestamp"))
    return F.unix_date(time).cast("long") if kind == "date" else time.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else time.cast("double")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str = "ts", right_time: str | None = None, direction: str = "backward", exact: bool = True, most: float | None = None, width: float | None = None, prefix: str = "r_") -> DataFrame:
    """left's rows, each with right's columns (by a prefix) of the row of the same key that is nearest in time: the last one at or before it (backward) or the first one at or after it (forward).

    Without exact, rows of the same time don't count. most keeps matches no further away than this (in microseconds, days or the times' own unit). Of right's rows with the same key and time
    the greatest counts, by its columns in order. Rows of left without a match, without a time or with a null in their key have nulls; right's such rows take no part. Repeated rows of left stay.

    Both tables are sorted together once, by key and range of time, and the last row of right is carried along; a range that has none yet takes it from the ranges before, of which only one row
    each is compared. width is a range's length, so a key with a third of all rows is as many tasks' as it has ranges; None: a key is one range.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"no direction {direction!r}")
    right_time = right_time or time
    sign = 1 if direction == "backward" else -1
    kinds = dict(left.dtypes), dict(right.dtypes)
    key = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    found = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    lefts = left.select(*key, (sign * _ticks(F.col(f"`{time}`"), kinds[0][time])).alias("_t"), F.lit(1 if exact else 0).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_right"))
    whole = F.col("_t").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rights = right.select(*key, (sign * _ticks(F.col(f"`{right_time}`"), kinds[1][right_time])).alias("_t"), F.lit(1 - (1 if exact else 0)).alias("_side"), F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"), found.alias("_right")).where(whole)
    both = lefts.where(whole).unionByName(rights)
    both = both.withColumn("_range", F.floor(F.col("_t") / F.lit(float(width))) if width else F.lit(0).cast("long"))
    # equal times: right's rows first if they count, the greatest last; a left row's own _right is null and sorts first on its side
    here = Window.partitionBy(*keys, "_range").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("_near", F.last(F.when(F.col("_right").isNotNull(), F.struct("_t", "_right")), ignorenulls=True).over(here)).where("_left IS NOT NULL").drop("_right")
    if width:
        ends = both.groupBy(*keys, "_range").agg(F.max(F.when(F.col("_right").isNotNull(), F.struct("_t", "_right"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        told = told.join(ends, [*keys, "_range"], "left").withColumn("_near", F.coalesce("_near", "_carried"))
    near = F.col("_near")
    if most is not None:
        near = F.when(F.col("_t") - near["_t"] <= most, near)
    out = told.select("_left", near["_right"].alias("_right")).unionByName(lefts.where(~F.coalesce(whole, F.lit(False))).select("_left", "_right"))
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_right")[c].alias(prefix + c) for c in right.columns])
