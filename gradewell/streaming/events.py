"""Structured Streaming forms of the session and feedback operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from gradewell.sources.sinks import FEEDBACK_SCHEMA, stamped


def read_events(spark: SparkSession, path: str, schema, time: str = "ts", max_files: int = 100) -> DataFrame:
    """A stream of Parquet files; event time without a zone is read in the session zone (UTC)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A stream of feedback documents, one per line; invalid ones are dropped, the rest stamped."""
    lines = spark.readStream.text(path)
    return stamped(lines.select(F.from_json("value", FEEDBACK_SCHEMA).alias("d")).select("d.*"))


def distinct_content(events: DataFrame, time: str, digest: str, delay: str = "1 hour") -> DataFrame:
    """Events with content not seen within the delay; state is dropped once the watermark has passed."""
    marked = events.withColumn("content_id", F.substring(digest, 1, 16))
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_id"])


def gap_sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Closed sessions per user, counted in event time; rows later than the delay are dropped."""
    windowed = events.withWatermark(time, delay).groupBy(user, F.session_window(F.col(time), gap).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def feedback_metrics(feedback: DataFrame, time: str, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return feedback.withWatermark(time, delay).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"), F.avg("seconds").alias("mean_seconds"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_rating", "mean_seconds")


def latest_states(updates: DataFrame, task: str, time: str, state: str = "state", delay: str = "1 hour",
                  keep_seconds: int = 7 * 86400) -> DataFrame:
    """Newest state per task, for update mode; a task without updates for ``keep_seconds`` of event time is forgotten.

    One (time, state) is kept per task. ``time`` must be a timestamp.
    """
    kinds = {c: updates.schema[c].dataType.simpleString() for c in (task, time, state)}

    def newest(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        before = held.get if held.exists else None
        best = before
        for batch in batches:
            row = batch.loc[batch[time].idxmax()]
            at = int(row[time].value // 1000)
            if best is None or at > best[0]:
                best = (at, row[state])
        if best != before:
            held.update(best)
            yield pd.DataFrame({task: [key[0]], time: [pd.Timestamp(best[0] * 1000)], state: [best[1]]})
        held.setTimeoutTimestamp(max(best[0] // 1000 + keep_seconds * 1000, held.getCurrentWatermarkMs() + 1))

    output = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    return updates.select(task, time, state).withWatermark(time, delay).groupBy(task).applyInPandasWithState(
        newest, output, f"at bigint, state {kinds[state]}", "update", "EventTimeTimeout")


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> DataStreamWriter:
    """Append-only file sink that processes what is there and stops."""
    return stream.writeStream.format(fmt).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True)
