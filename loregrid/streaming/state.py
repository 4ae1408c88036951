"""State with time: feedback weights that decay, and the context that a conversation carries along. Both run as streams, whose state lives in RocksDB and ends by timers, and as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and time to live need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


# ---------------------------------------------------------------- weights that decay


def _worth(action: str = "action", value: str | None = None) -> Column:
    """What an event adds: its value, or 1 for accepted, 1/2 for modified, -1 for rejected and 0 for all others."""
    if value:
        return F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return F.when(F.col(action) == "accepted", 1.0).when(F.col(action) == "modified", 0.5).when(F.col(action) == "rejected", -1.0).otherwise(0.0)


def decayed(events: DataFrame, key: str, half_life: float, value: str | None = None) -> DataFrame:
    """key, weight, n, at of a batch: the worth of each key's events, each halved once for every half_life seconds before the key's last event (at). Null keys and times take no part."""
    e = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts"), _worth(value=value).alias("w"))
    last = e.groupBy(key).agg(F.max("ts").alias("at"), F.count("*").alias("n"))
    age = (F.unix_micros("at") - F.unix_micros("ts")) / F.lit(1e6 * half_life)
    sums = e.join(last, key).groupBy(key, "n", "at").agg(F.sum(F.col("w") * F.pow(F.lit(2.0), -age)).alias("weight"))
    return sums.select(key, F.round("weight", 6).alias("weight"), "n", "at")


class Decay(StatefulProcessor):
    """A key's weight as of its last event. Events may come in any order: an older one adds what is left of it. Without events for idle seconds (of event time) the key is forgotten."""

    def __init__(self, key: str, half_life: float, idle: float):
        self.key, self.half_life, self.idle = key, half_life, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("weight", "weight double, n long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        weight, n, at = self.state.get() if self.state.exists() else (0.0, 0, None)
        for frame in rows:
            for t, w in zip(frame["t"].tolist(), frame["w"].tolist()):
                if at is None or t >= at:
                    weight, at = weight * 2.0 ** (-(t - at) / (1e6 * self.half_life)) + w if at is not None else w, t
                else:
                    weight += w * 2.0 ** (-(at - t) / (1e6 * self.half_life))
                n += 1
        self.state.update((weight, n, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + int(1000 * self.idle))
        yield pd.DataFrame({self.key: [key[0]], "weight": [round(weight, 6)], "n": [n], "at": [pd.Timestamp(at, unit="us")], "forgotten": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        weight, n, at = self.state.get()
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "weight": [0.0], "n": [n], "at": [pd.Timestamp(at, unit="us")], "forgotten": [True]})

    def close(self) -> None:
        pass


def decaying(events: DataFrame, key: str, half_life: float, idle: float = 30 * 86_400.0, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """A stream of key, weight, n, at, forgotten: of each key with new events its weight as decayed() has it, and of a key without events for idle seconds one last row. Later than the watermark is dropped."""
    use_rocksdb(events.sparkSession)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col(key).isNotNull())
    e = e.select(key, "ts", F.unix_micros("ts").alias("t"), _worth(value=value).alias("w"))
    schema = f"{key} {dict(events.dtypes)[key]}, weight double, n long, at timestamp, forgotten boolean"
    return e.groupBy(key).transformWithStateInPandas(Decay(key, half_life, idle), schema, "Update", "EventTime")


# ---------------------------------------------------------------- conversations


def with_context(turns: DataFrame, most: int = 3) -> DataFrame:
    """conv_id, turn, text, context of a batch: each turn with the texts of up to most turns before it, the oldest first. Turns that repeat a number are ordered by their text; null texts are empty."""
    order = Window.partitionBy("conv_id").orderBy("turn", "_text").rowsBetween(-most, -1)
    t = turns.withColumn("_text", F.coalesce("text", F.lit("")))
    return t.select("conv_id", "turn", F.col("_text").alias("text"), F.collect_list("_text").over(order).alias("context"))


class Context(StatefulProcessor):
    """The last turns of a conversation, forgotten after idle milliseconds of processing time without a turn, if there is such a limit."""

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "text string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.last.get()] if self.last.exists() else []
        new = pd.concat(list(rows)).sort_values(["turn", "text"], kind="stable")
        out = []
        for turn, text in zip(new["turn"], new["text"]):
            out.append((key[0], turn, text, held[-self.most :]))
            held = [*held, text][-self.most :]
        self.last.put([(t,) for t in held])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "context"])

    def close(self) -> None:
        pass


def carried(turns: DataFrame, most: int = 3, idle_ms: int | None = None) -> DataFrame:
    """A stream of conv_id, turn, text, context as with_context() has them, where the turns of a conversation come in order, over any number of batches.

    With idle_ms conversations end by time to live, which needs a trigger that goes on: one for what is available now never ends then.
    """
    use_rocksdb(turns.sparkSession)
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    kinds = dict(turns.dtypes)
    return t.groupBy("conv_id").transformWithStateInPandas(Context(most, idle_ms), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, text string, context array<string>", "Append", "ProcessingTime" if idle_ms else "None")
