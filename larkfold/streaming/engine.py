"""Streaming versions of the tick operators: bars, sessions, deduplication and a stateful feature per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from larkfold.sources.adapters import epoch_ms

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, directory: str, files: int | None = None, names: str = "events.parquet") -> DataFrame:
    """Events of a directory as a stream (``files`` a micro-batch, of those whose names fit), with event time as a timestamp that doesn't depend on the session's zone."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", names)
    r = r.option("maxFilesPerTrigger", files) if files else r
    return r.parquet(directory).withColumn("time_msc", epoch_ms("ts")).withColumn("time", F.timestamp_millis("time_msc"))


def tumbling(events: DataFrame, size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Bars of ``value`` by type over tumbling (or sliding) windows; rows later than ``late`` behind the newest are dropped and counted by Spark."""
    o = F.struct("time_msc", "event_id")
    g = events.withWatermark("time", late).groupBy("event_type", F.window("time", size, slide).alias("w"))
    bars = g.agg(F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.count("*").alias("n"))
    return bars.select("event_type", F.unix_millis("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    g = events.withWatermark("time", late).groupBy("user_id", F.session_window("time", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end"), "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("time", late).dropDuplicatesWithinWatermark([key])


FEATURES = "event_type string, seq_no long, n long, skipped long, ema double, high double, low double"
STATE = "last_ms long, n long, skipped long, ema double, high double, low double"


def features(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row for each micro-batch and symbol: the state after it. A tick older than the last one is skipped and counted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, skipped, ema, high, low = state.get if state.exists else (-1, 0, 0, 0.0, float("-inf"), float("inf"))
        rows = pd.concat(list(batches)).sort_values(["time_msc", "event_id"])
        for ms, v in zip(rows["time_msc"], rows["value"], strict=True):
            if ms < last:
                skipped += 1
                continue
            last, ema = ms, v if n == 0 else ema + alpha * (v - ema)
            n, high, low = n + 1, max(high, v), min(low, v)
        state.update((int(last), int(n), int(skipped), float(ema), float(high), float(low)))
        yield pd.DataFrame([(key[0], int(last), int(n), int(skipped), float(ema), float(high), float(low))], columns=["event_type", "seq_no", "n", "skipped", "ema", "high", "low"])

    narrow = events.select("event_type", "time_msc", "event_id", "value")
    return narrow.groupBy("event_type").applyInPandasWithState(step, FEATURES, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there. ``complete`` rewrites the result with each micro-batch and keeps all state; ``update`` writes what a micro-batch changes, so
    that the watermark frees state, and the latest row of each of ``keys`` counts (without keys, all rows do); ``append`` writes rows that are final."""
    spark = stream.sparkSession

    def save(batch: DataFrame, epoch: int) -> None:
        out = f"{path}/out" if mode == "complete" else f"{path}/out/_epoch={epoch}"  # a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    got = spark.read.schema(StructType([*stream.schema, StructField("_epoch", IntegerType())])).parquet(f"{path}/out")
    if not keys:
        return got.drop("_epoch")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in stream.columns])
