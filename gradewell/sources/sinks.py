"""Writers: append-only events, reports, resumable outputs, bad-record side outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FEEDBACK_SCHEMA = (
    "session_id string, image_count int, retake_count int, time_to_finish_seconds double, "
    "image_quality_warnings array<string>, result_shown string, ease_of_use_rating int, clarity_rating int, "
    "trust_rating int, notes string"
)
RATINGS = ["ease_of_use_rating", "clarity_rating", "trust_rating"]


def feedback_valid() -> Column:
    """Session named, counts and time not negative, ratings missing or 1-5."""
    ok = F.col("session_id").isNotNull() & (F.length("session_id") > 0)
    for name in ("image_count", "retake_count", "time_to_finish_seconds"):
        ok = ok & (F.coalesce(F.col(name), F.lit(0)) >= 0)
    for name in RATINGS:
        ok = ok & (F.col(name).isNull() | F.col(name).between(1, 5))
    return ok


def stamped(events: DataFrame) -> DataFrame:
    """Valid events with the UTC time of writing as ISO text."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return events.filter(feedback_valid()).withColumn("created_at", now)


def append_feedback(events: DataFrame, path: str) -> None:
    """One JSON document per line, append only."""
    stamped(events).write.mode("append").json(path)


def union_reports(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several reports under the union of their columns; missing values are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """The rows of a report as Markdown table lines, with their order; header and rule come first."""
    def cell(name: str) -> Column:
        return F.coalesce(F.replace(F.col(name).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    header = "| " + " | ".join(df.columns) + " |"
    rule = "| " + " | ".join("---" for _ in df.columns) + " |"
    top = df.sparkSession.createDataFrame([(0, header), (1, rule)], "part int, line string")
    return top.unionByName(df.select(F.lit(2).alias("part"), line.alias("line")))


def read_existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """A previous output, or an empty table when there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def append_pending(rows: DataFrame, kernel: Callable[[DataFrame], DataFrame], path: str, key: str, batch: str = "batch") -> int:
    """Resumable write: only rows whose key is missing from the output go through ``kernel`` and are appended; returns their number.

    Done keys are taken out before the kernel, so finished work is not done again. The commit protocol of the
    writer takes the place of partial files: a failed attempt leaves nothing.
    """
    done = read_existing(rows.sparkSession, path, kernel(rows.limit(0)).schema)
    written = Observation()
    todo = kernel(pending(rows, done, key)).observe(written, F.count(F.lit(1)).alias("n"))
    writer = todo.write.mode("append")
    (writer.partitionBy(batch) if batch in todo.columns else writer).parquet(path)
    return written.get["n"]


def split_results(results: DataFrame, ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of a table of results with a flag; fails only when every row is bad."""
    totals = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("good")).first()
    if totals["n"] > 0 and totals["good"] == 0:
        raise ValueError(f"all {totals['n']} rows failed")
    return results.filter(F.col(ok)), results.filter(~F.col(ok))


def write_failures(bad: DataFrame, path: str) -> None:
    """Failures as tab-separated source, label, path, error."""
    columns = ["source", "label", "path", "error"]
    bad.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option(
        "sep", "\t").option("header", True).csv(path)
