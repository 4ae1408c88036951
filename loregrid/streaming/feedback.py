"""Feedback and sessions over time. Every function takes a batch or a streaming DataFrame of events (ts, id, action, ...)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp (watermarks refuse those without a zone); late rows are dropped from streams alone."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if e.isStreaming else e


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, action, n, total of consecutive windows."""
    w = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("w.start").alias("start"), "action", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n, accepted of overlapping windows."""
    w = _timed(events, late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "accepted").alias("accepted"))
    return w.select(F.col("w.start").alias("start"), "n", "accepted")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n of runs of events without a gap."""
    w = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_weights(events: DataFrame, key: str = "id") -> DataFrame:
    """A stream of key, accepted, total after each batch, with the counts kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def add(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        accepted, total = state.get if state.exists else (0, 0)
        for pdf in batches:
            accepted, total = accepted + int((pdf["action"] == "accepted").sum()), total + len(pdf)
        state.update((accepted, total))
        yield pd.DataFrame({key: [k[0]], "accepted": [accepted], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, accepted long, total long", "accepted long, total long", "update", GroupStateTimeout.NoTimeout)


def ingest(changed: DataFrame, root: str, name: str, checkpoint: str, key: str = "id", order: str | None = None, deleted: str | None = None):
    """Keeps an index table up to date from a stream of changed rows, see segments.apply(): each batch is a segment of its own on top of what is there. Returns the query.

    The table may come from a batch run. Batches are known by the stream's checkpoint, so a batch that is run again after a failure changes nothing, and a new checkpoint starts anew.
    """
    from ..sources import segments

    def apply(batch: DataFrame, number: int) -> None:
        segments.apply(batch, root, name, key, deleted, order, (checkpoint, number))

    return changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
