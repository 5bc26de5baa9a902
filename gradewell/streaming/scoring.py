"""Scoring of a stream of images with gate and reconciliation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.decisions import reconcile, screening_result
from gradewell.functions.probability import first_argmax


def score_stream(events: DataFrame, grading: PipelineModel, quality_ok: Column, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Grade, positive probability and screening result of every event; stateless, so it runs on streams and tables.

    Events that fail the gate keep a row and carry no probability.
    """
    scored = grading.transform(events.withColumn("_ok", quality_ok))
    prob = vector_to_array("probability")
    scored = scored.withColumn("_prob", prob)
    positive = F.aggregate(F.filter("_prob", lambda p, i: i >= K.POSITIVE_MIN_GRADE), F.lit(0.0), lambda a, p: a + p)
    scored = scored.withColumn("_p", positive).withColumn("grade", first_argmax(F.col("_prob")))
    decision = reconcile(F.col("_p") >= threshold, F.col("grade"))
    fields = screening_result(F.col("_ok"), F.lit(True), decision["status"] == "aligned", F.col("_p") >= threshold, F.col("_p"))
    fields["result_label"] = fields.pop("label")  # events may bring a label of their own
    drop = ["_ok", "_prob", "_p", "features", "probability", "rawPrediction", "prediction"]
    return scored.select("*", *[c.alias(n) for n, c in fields.items()]).drop(*[c for c in drop if c in scored.columns])
