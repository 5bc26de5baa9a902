"""Sessions of images: aggregates, decisions, size guard, history, task states.

All group aggregates combine on the map side and keep one row per session and task, so a session
key holding a large share of the events does not gather them in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_IMAGES = 9


def session_summary(images: DataFrame, by: Sequence[str], order: str, name: str, quality_ok: str = "quality_ok",
                    result: str = "result", probability: str = "positive_probability", grade: str = "grade") -> DataFrame:
    """Image and poor-quality counts, strongest probability with its image, largest grade, session result.

    A missing probability counts as 0 for the strongest image; the first image wins ties. A session is
    uncertain when more than half of its images are poor, positive when any usable image is, negative
    when every usable image is, otherwise uncertain (so a review result makes it uncertain).
    """
    p = F.coalesce(F.col(probability), F.lit(0.0))
    ok = F.col(quality_ok)
    grouped = images.groupBy(*by).agg(
        F.count(F.lit(1)).alias("image_count"), F.count_if(~ok).alias("poor_quality_count"),
        F.max(p).alias("strongest_probability"), F.max_by(name, F.struct(p, -F.col(order))).alias("strongest_image"),
        F.max(grade).alias("max_grade"), F.count_if(ok).alias("_usable"),
        F.count_if(ok & (F.col(result) == "referable")).alias("_positive"),
        F.count_if(ok & (F.col(result) == "non_referable")).alias("_negative"))
    decision = (
        F.when(F.col("poor_quality_count") * 2 > F.col("image_count"), "uncertain")
        .when(F.col("_positive") > 0, "referable")
        .when((F.col("_usable") > 0) & (F.col("_negative") == F.col("_usable")), "non_referable").otherwise("uncertain"))
    return grouped.withColumn("session_result", decision).drop("_usable", "_positive", "_negative")


def mean_probabilities(images: DataFrame, by: Sequence[str], probabilities: str) -> DataFrame:
    """Mean per key of a probability map over the images that have the key, as a map, six decimals."""
    entries = images.select(*by, F.explode(probabilities).alias("k", "v"))
    # Half to even on the decimal value: digits beyond the twelfth are noise of the summation.
    means = entries.groupBy(*by, "k").agg(F.bround(F.round(F.avg("v"), 12), 6).alias("v"))
    return means.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("average_probabilities"))


def guard_sizes(images: DataFrame, by: Sequence[str], limit: int = MAX_IMAGES) -> tuple[DataFrame, DataFrame]:
    """(images of sessions with 1..limit images, rejected sessions with their size)."""
    sizes = images.groupBy(*by).agg(F.count(F.lit(1)).alias("image_count"))
    rejected = sizes.filter(F.col("image_count") > limit)
    # Oversized sessions are the hot ones: their rows are dropped by an anti-join, never gathered.
    return images.join(rejected, list(by), "left_anti"), rejected


def distinct_content(events: DataFrame, digest: str, order: str) -> DataFrame:
    """The first row, by ``order``, of every content id (the leading 16 digits of the digest); copies combine on the map side."""
    marked = events.withColumn("content_id", F.substring(digest, 1, 16))
    first = marked.groupBy("content_id").agg(F.min_by(F.struct(*events.columns), order).alias("_row"))
    return first.select("content_id", "_row.*")


def gap_sessions(events: DataFrame, user: str, time: str, gap_seconds: int) -> DataFrame:
    """Batch session windows: (user, start, end, n); end is the last event plus the gap.

    Events in one interval of the length of the gap are always of one session, so they are first combined to
    (user, interval, first, last, n) on the map side. What is put in order per user are these intervals: as many as
    the time the table spans has, however many events the user has. Events without a time belong to no session; NULL is a user.
    """
    gap = F.make_dt_interval(secs=F.lit(gap_seconds))
    intervals = events.groupBy(user, F.window(time, f"{gap_seconds} seconds").alias("_w")).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(user).orderBy("_first")
    same = F.col("_first") < F.lag("_last").over(order) + gap
    numbered = intervals.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(order))
    return numbered.groupBy(user, "_k").agg(
        F.min("_first").alias("start"), (F.max("_last") + gap).alias("end"), F.sum("n").alias("n")).select(user, "start", "end", "n")


def feedback_metrics(feedback: DataFrame, time: str, window: str, slide: str | None = None) -> DataFrame:
    """Number, mean rating and mean time of feedback per tumbling or sliding window."""
    w = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return feedback.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"), F.avg("seconds").alias("mean_seconds"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_rating", "mean_seconds")


def warning_counts(feedback: DataFrame, time: str, warnings: str, window: str) -> DataFrame:
    """Occurrences of each warning per window."""
    long = feedback.select(time, F.explode(warnings).alias("warning"))
    return long.groupBy(F.window(F.col(time), window).alias("w"), "warning").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "warning", "n")


# Task states in the order in which a task passes them (fixed values).
TASK_STATES = ["PENDING", "STARTED", "SUCCESS", "FAILURE"]


def latest_states(updates: DataFrame, task: str, time: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The newest update per task."""
    newest = F.max_by(F.struct(time, *columns), F.struct(time, tie)).alias("s")
    return updates.groupBy(task).agg(newest).select(task, *[F.col(f"s.{c}") for c in [time, *columns]])


def recent_history(entries: DataFrame, user: str, order: Sequence[Column], limit: int = 12) -> DataFrame:
    """The newest ``limit`` entries per user, numbered; tasks cut to ``limit`` rows per user before the shuffle."""
    w = Window.partitionBy(user).orderBy(*order)
    return entries.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
