"""Stored models, metrics and encoders."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskframe.sources import tables
from riskframe.sources.schemas import MODEL_METRICS, conform


def save_model(model: PipelineModel, folder: str, name: str) -> None:
    """Replace the model of that name, once all of it is written."""
    spark = SparkSession.active()
    tables.staged(spark, f"{folder}/{name}", lambda path: model.write().save(path))


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(tables.current(SparkSession.active(), f"{folder}/{name}"))


def append_metrics(rows: DataFrame, path: str, run: str | None = None) -> str:
    """Add a run's metrics; a run that is repeated under its key replaces its own."""
    return tables.put_run(conform(rows, MODEL_METRICS), path, run, format="json")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    rows = tables.read_runs(spark, path, MODEL_METRICS, format="json")
    return rows.select(*MODEL_METRICS.fieldNames())


def save_codes(codes: DataFrame, path: str) -> None:
    """The encoder: (feature, value, code)."""
    tables.replace(codes, path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return tables.read(spark, path, "feature string, value string, code long")
