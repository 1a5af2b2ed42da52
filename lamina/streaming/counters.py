"""Streams: counters and class rates by micro-batch, and traversal state per sub-volume that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def counter_totals(events: DataFrame) -> DataFrame:
    """Running totals by counter name."""
    return events.groupBy("name").agg(F.sum("delta").cast("long").alias("value"), F.count("*").alias("calls"))


def windowed_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "name").agg(F.count("*").alias("n"))


def class_rates(batch: DataFrame) -> DataFrame:
    """Share of each class within one micro-batch, as a foreachBatch step."""
    total = batch.agg(F.count("*").alias("_t"))
    return batch.groupBy("name").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("name", "n", (F.col("n") / F.greatest("_t", F.lit(1))).alias("rate"))


def progress(events: DataFrame) -> DataFrame:
    """Last step and number of updates of each sub-volume, kept as keyed state across batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (-1, 0)
        for rows in batches:
            last = max(last, int(rows["step"].max()))
            n += len(rows)
        state.update((last, n))
        yield pd.DataFrame({"corner": [key[0]], "last_step": [last], "updates": [n]})

    return events.groupBy("corner").applyInPandasWithState(update, "corner string, last_step long, updates long", "last_step long, updates long", "update", "NoTimeout")


def run_once(out: DataFrame, sink: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Work through what is there and stop; the checkpoint lets the next call go on from there."""
    q = out.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
