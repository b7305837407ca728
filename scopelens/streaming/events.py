"""Structured Streaming over ``events``: watermarked windows, sessions, deduplication, per-user state, keyed appends.

An extension: what the batch operators do on stored logs, on logs that are still growing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import append_new


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come; event times without a zone are read in the session's."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_means(events: DataFrame, late: str = "1 hour", width: str = "6 hours", slide: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return w.agg(F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "mean")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after every batch that brings a user something; state holds two numbers per user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def append_once(events: DataFrame, path: str, checkpoint: str):
    """Appends each key once, also when a batch is replayed after a failure."""
    return events.writeStream.foreachBatch(lambda df, _: append_new(df, path, ["event_id"])).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and gives its table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def fed(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What ``stream`` has given once the parts have arrived one after the other.

    Each part is appended to a folder of files and taken in by a run of its own, which goes on from the checkpoint of
    the run before, so watermarks and state live on and rows that come after their watermark are dropped.
    """
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/arrived")
        events = read_events(spark, f"{folder}/arrived", per_trigger=1_000_000)
        run = stream(events).writeStream.format("parquet").option("path", f"{folder}/given").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/given")
