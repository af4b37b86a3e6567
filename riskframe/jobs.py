"""The three steps end to end, on tables under one folder.

``patients`` and ``predictions`` are Parquet, ``metrics`` is JSON, ``models``
holds one folder per model and the category codes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.learning.models import FOREST, SPECS, Spec
from riskframe.learning.workflow import (
    Trained,
    classifier_of,
    importances,
    metrics_rows,
    numbered,
    predictions_of,
    score_all,
    train_models,
)
from riskframe.operators.cleaning import clean, decode, min_max_normalize
from riskframe.operators.features import engineer_features
from riskframe.operators.ids import assign_ids
from riskframe.plans.catalog import register_views
from riskframe.plans.sums import SumsTable
from riskframe.session import materialize, scratch_scope
from riskframe.sources import files, stores
from riskframe.sources.schemas import CLINICAL_TYPES, FEATURE_TYPES


# Measurements that are also stored scaled to 0 to 1.
SCALED = {
    "trestbps": "trestbps_normalized",
    "chol": "chol_normalized",
    "thalach": "thalach_normalized",
    "oldpeak": "oldpeak_normalized",
}


def prepare_patients(
    spark: SparkSession,
    raw_csv: str,
    folder: str,
    created_at: datetime | None = None,
    most_bad: int | None = None,
) -> None:
    """Raw CSV to the patients table, which is replaced.

    With ``most_bad`` so many lines that cannot be read are put beside the table,
    as ``bad_lines``; without it the first one fails the job.
    """
    with scratch_scope(spark):
        bad_lines = None if most_bad is None else f"{folder}/bad_lines"
        raw = files.load_raw(spark, raw_csv, bad_lines, most_bad)
        ready = patients_from(clean(raw, places=True))
        files.write_patients(ready, f"{folder}/patients", created_at)


def prepare_clinical(
    spark: SparkSession,
    raw_folder: str,
    folder: str,
    labels: Mapping[str, tuple[str, Mapping[int, str]]],
    created_at: datetime | None = None,
) -> None:
    """The raw clinical table to the patients table, which is replaced.

    ``labels`` says what the codes mean, as ``decode`` takes it. The raw table's
    own ids and times are not part of a patient: rows that differ in them alone
    are copies.
    """
    with scratch_scope(spark):
        raw = files.read_clinical(spark, raw_folder).drop("id", "created_at")
        cleaned = clean(raw, [c for c in (*SCALED, "age") if c in raw.columns], places=True)
        ready = patients_from(cleaned, labels)
        files.write_patients(ready, f"{folder}/patients", created_at)


def patients_from(
    cleaned: DataFrame, labels: Mapping[str, tuple[str, Mapping[int, str]]] | None = None
) -> DataFrame:
    """Cleaned rows with ids, scaled measurements, decoded attributes and features."""
    scaled = {c: name for c, name in SCALED.items() if c in cleaned.columns}
    rows = min_max_normalize(assign_ids(cleaned), scaled)
    if labels:
        rows = decode(rows, labels)
    if "ca" in rows.columns:
        rows = rows.withColumn("ca_count", F.col("ca").cast("int"))
    return engineer_features(rows, keep=[c for c in CLINICAL_TYPES if c in rows.columns])


def train_and_store(
    spark: SparkSession,
    folder: str,
    specs: Sequence[Spec] = SPECS,
    run_ts: datetime | None = None,
) -> Trained:
    """Train on the patients table; store models, codes, metrics and predictions.

    Predictions of the held-out patients and the metrics are appended, models
    and importances replaced. A job that is repeated for the same ``run_ts``
    replaces its own predictions and metrics.
    """
    run = None if run_ts is None else run_ts.isoformat()
    patients = files.read_patients(spark, f"{folder}/patients").select("id", *FEATURE_TYPES)
    with scratch_scope(spark):
        trained = train_models(patients, specs)
        for name, model in trained.models.items():
            stores.save_model(model, f"{folder}/models", name)
        stores.save_codes(trained.codes, f"{folder}/models/codes")
        if FOREST.name in trained.models:
            forest = classifier_of(trained.models[FOREST.name])
            table = importances(spark, forest, trained.train.columns)
            files.write_csv(table, f"{folder}/models/feature_importance")
        earlier = files.stored_predictions(spark, f"{folder}/predictions", run)
        scored = materialize(numbered(score_all(trained, run_ts), earlier), "scored")
        files.append_predictions(predictions_of(scored), f"{folder}/predictions", run)
        stores.append_metrics(metrics_rows(trained, scored, run_ts), f"{folder}/metrics", run)
    return trained


def open_views(spark: SparkSession, folder: str) -> list[str]:
    """Register all views over the stored tables, and return their names.

    Sums of predictions are brought up to date first, which reads new runs alone.
    """
    patients, predictions = f"{folder}/patients", f"{folder}/predictions"
    kept = SumsTable(f"{folder}/sums", patients, predictions)
    kept.update(spark)
    return register_views(
        spark,
        files.read_patients(spark, patients),
        files.read_predictions(spark, predictions),
        stores.read_metrics(spark, f"{folder}/metrics"),
        kept_sums=kept.read(spark),
    )
