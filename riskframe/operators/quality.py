"""Checks that a relational store would enforce by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_predictions(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    """(patient_id, predictions): references to patients that do not exist.

    Predictions are counted per patient before the anti join, so a single
    unknown patient with many rows is one row there.
    """
    counted = (
        predictions.where(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(F.count(F.lit(1)).alias("predictions"))
    )
    known = patients.select("id")
    return counted.join(known, counted["patient_id"] == known["id"], "left_anti")
