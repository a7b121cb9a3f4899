"""Prediction sink: exactly one validated row per expected event, in the expected order."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.checks import check_predictions, enforce


def prediction_rows(pred: DataFrame, expected: DataFrame) -> DataFrame:
    """Predictions as float32 vectors with the position of their event (``narration_id, position``)."""
    p = pred.select("narration_id", F.col("verb_output").cast("array<float>").alias("verb_output"),
                    F.col("noun_output").cast("array<float>").alias("noun_output"))
    return expected.select("narration_id", "position").join(p, "narration_id")


def write_predictions(pred: DataFrame, expected: DataFrame, path: str, num_verbs: int = 97, num_nouns: int = 300) -> None:
    """Check coverage, width and finiteness, then write Parquet ordered by position across files; an
    existing output is never replaced."""
    enforce(check_predictions(pred, expected, num_verbs, num_nouns))
    rows = prediction_rows(pred, expected)
    rows.repartitionByRange("position").sortWithinPartitions("position").write.mode("errorifexists").parquet(path)
