"""Training corpus pipeline: quality, repeated lines, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read as the next one's docs. All
but the last return the columns of ``documents``. Rows with null ids or texts, repeated rows and empty tables pass as the
operators define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import lines, packing, quality, simhash
from gradewell.llm.queries import documents_of, feedback, learnt_labels, table
from gradewell.session import store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labels it may learn from, does not reject."""
    texts = feedback(docs)
    return docs_of(quality.keep_good(texts, quality.train_quality(texts, learnt_labels(spark, sf_dir))), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` follows the text."""
    kept = lines.drop_repeated_lines(feedback(docs)).drop("n_lines", "n_dropped", "free_text_feedback")
    kept = kept.withColumnRenamed("kept_text", "free_text_feedback").withColumn("n_chars", F.length("free_text_feedback").cast("bigint"))
    return docs_of(kept, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each near-duplicate group."""
    return docs_of(simhash.keep_one_per_group(feedback(docs)), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences."""
    return documents_of(packing.pack_feedback(feedback(docs), public_tokenizers.path("word_bpe_49k.json")))


def docs_of(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.withColumnsRenamed({"session_id": "doc_id", "free_text_feedback": "text"}).select(*docs.columns)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Compression, fingerprints and tokenizers are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
