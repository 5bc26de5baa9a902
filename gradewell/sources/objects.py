"""Stored objects: bytes, content hashes and decoded pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_bytes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file; the bytes themselves are dropped after hashing."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 16).alias("content_id"))


def scan_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(path, readable, width, height, channels, data); undecodable files stay as rows with readable = false."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    return images.select(
        F.col("image.origin").alias("path"), (F.col("image.width") > 0).alias("readable"), "image.width", "image.height",
        F.col("image.nChannels").alias("channels"), "image.data")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Pixels with the content hash of the file. Paths are unique, so the join has no hot key."""
    def plain(name: str):
        return F.regexp_replace(F.col(name), "^file:/+", "/")

    hashes = scan_bytes(spark, root).withColumn("path", plain("path"))
    return scan_pixels(spark, root).withColumn("path", plain("path")).join(hashes, "path")
