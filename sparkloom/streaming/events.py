"""Structured Streaming over event files: windows with late data, sessions, de-duplication, running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with the session's zone; one without is read in it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, keys, n, total per window; events later than the watermark are dropped. Batch tables give the same rows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total after each trigger, kept in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, through the stream, into a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
