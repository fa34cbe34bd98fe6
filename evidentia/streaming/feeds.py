"""Structured Streaming over the event table: status feed, windows, sessions and a state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.sources.session import shared_dir, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table's files as a stream."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what is there now, read back as a batch.

    Each micro-batch goes to a folder of its own number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid4().hex}"
    write: Callable[[DataFrame, int], None] = lambda rows, nr: rows.write.mode("overwrite").parquet(f"{base}/rows/batch={0 if mode == 'complete' else nr}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").drop("batch")


def latest_status(events: DataFrame) -> DataFrame:
    """Each user's latest event type and how many events there were: the state that a status feed shows."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("last"), F.count("*").alias("events")).select("user_id", F.col("last.event_type").alias("status"), F.col("last.ts").alias("at"), "events")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and mean value of each hour and type; an hour is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("window.start").alias("hour"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between them."""
    own = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return own.select("user_id", F.col("session_window.start").alias("start_at"), "n", "total")


def episodes(events: DataFrame, high: float = 60.0, low: float = 5.0) -> DataFrame:
    """Finished writing episodes of a user, kept as state between micro-batches: start, end, peak and rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        for at, x in zip(rows["sec"], rows["value"], strict=True):
            if held is None and x >= high:
                held = [at, at, x, 1]
            elif held is not None:
                held = [held[0], at, max(held[2], x), held[3] + 1]
                if x <= low:
                    out.append([key[0], *held])
                    held = None
        if held is not None:
            state.update(tuple(held))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "start_at", "end_at", "peak", "n"])

    rows = events.select("user_id", "event_id", "value", F.col("ts").cast("double").alias("sec"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, start_at double, end_at double, peak double, n long", "start_at double, end_at double, peak double, n long", "append", GroupStateTimeout.NoTimeout)
