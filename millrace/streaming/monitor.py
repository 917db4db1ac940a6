"""Metric streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(stream: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count, mean and maximum by window and type; rows later than `lateness` are dropped."""
    grouped = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "max")


def ema(stream: DataFrame, key: str = "user_id", decay: float = 0.99, spike: float = 5.0) -> DataFrame:
    """key, steps, ema, spikes after each batch: keyed state with the moving average that spikes don't enter.

    A key's rows of a batch are taken in order of time; the state is three numbers a key.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, steps, spikes = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for x in rows["value"]:
            base = x if average is None else average
            if x / max(base, 1e-12) > spike:
                spikes += 1
            else:
                average = decay * base + (1 - decay) * x
            steps += 1
        state.update((average, steps, spikes))
        yield pd.DataFrame({key: [k[0]], "steps": [steps], "ema": [average], "spikes": [spikes]})

    out, kept = f"{key} bigint, steps bigint, ema double, spikes bigint", "ema double, steps bigint, spikes bigint"
    return stream.groupBy(key).applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def metric_lines(stream: DataFrame, path: str, checkpoint: str):
    """As written, each batch added as JSON lines."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def written(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes what there is as Parquet and stops; it goes on from its checkpoint the next time."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
