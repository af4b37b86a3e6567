"""Sums of predictions, kept run by run, that the aggregated views are read from.

A run's predictions are read once, when they are new. What is kept of them has a
row per day, model, class, score range and patient group: it grows with days and
models, not with predictions. Sums of runs are added up when a view is read.

Every run's sums carry the versions of what they were made from, the run's
predictions, the patients table and the limits. A run that was repeated, a new
patients table or other limits leave sums behind that nothing asks for any more;
they are made anew by the next update, and deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import astuple, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import (
    confidence_level,
    correctness,
    period_start,
    risk_category,
    risk_factors,
)
from riskframe.functions.labels import (
    CONFIDENCE_THRESHOLDS,
    OLDER_GROUPS,
    RISK_FACTOR_CUTOFF,
    RISK_THRESHOLDS,
)
from riskframe.plans.views import (
    mean_score,
    scores_per_patient,
    share_of_rows,
    sum_where,
    total,
)
from riskframe.sources import files, tables

GROUPS = ("age_group", "sex", "target", "exang")
KEYS = (
    "day", "model_name", "prediction", "risk_category", "confidence_level", "bin", "above",
    "known", *GROUPS,
)
SCHEMA = T.StructType(
    [
        T.StructField("day", T.TimestampNTZType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("risk_category", T.StringType()),
        T.StructField("confidence_level", T.StringType()),
        T.StructField("bin", T.LongType()),
        T.StructField("above", T.BooleanType()),
        T.StructField("known", T.BooleanType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("exang", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("n_scored", T.LongType()),
        T.StructField("score_sum", T.DoubleType()),
        T.StructField("score_min", T.DoubleType()),
        T.StructField("score_max", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Limits:
    """Where scores are cut; sums hold for one set of limits."""

    risk: Sequence[float] = RISK_THRESHOLDS
    confidence: Sequence[float] = CONFIDENCE_THRESHOLDS
    cutoff: float = RISK_FACTOR_CUTOFF
    #: Equal bins of the histogram, from 0 to 1.
    bins: int = 20


def added(sums: DataFrame) -> DataFrame:
    """Sums of equal keys in one row."""
    return sums.groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.sum("n_scored").alias("n_scored"),
        F.sum("score_sum").alias("score_sum"),
        F.min("score_min").alias("score_min"),
        F.max("score_max").alias("score_max"),
    )


def prediction_sums(
    patients: DataFrame, predictions: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """The sums of some predictions. Those of unknown patients have ``known`` false.

    Predictions are summed up per patient before they meet the patients, so that
    one who owns a third of them is a few rows.
    """
    score = F.col("probability")
    per_patient = scores_per_patient(
        predictions,
        period_start(F.col("created_at"), "day").cast("timestamp_ntz").alias("day"),
        "model_name",
        "prediction",
        risk_category(score, limits.risk).alias("risk_category"),
        confidence_level(score, limits.confidence).alias("confidence_level"),
        F.when(
            score.isNotNull(), F.least(F.floor(score * limits.bins), F.lit(limits.bins - 1))
        ).cast("long").alias("bin"),
        (score > limits.cutoff).alias("above"),
    )
    side = patients.select(F.col("id").alias("_id"), *GROUPS)
    met = per_patient.join(side, per_patient["patient_id"] == side["_id"], "left")
    return added(met.withColumn("known", F.col("_id").isNotNull()))


@dataclass(frozen=True)
class SumsTable:
    """Sums at ``path`` of the predictions of a stored table and their patients."""

    path: str
    patients: str
    predictions: str
    limits: Limits = field(default_factory=Limits)

    def _keys(self, spark: SparkSession) -> dict[str, str]:
        """The key that the sums of each run have if they are up to date."""
        made_from = (tables.current(spark, self.patients), astuple(self.limits))
        found = {}
        for run in tables.runs(spark, self.predictions):
            folder = tables.run_folder(spark, self.predictions, run)
            text = repr((run, folder, *made_from))
            found[run] = hashlib.sha256(text.encode()).hexdigest()
        return found

    def update(self, spark: SparkSession) -> list[str]:
        """Add the sums of runs that are new or changed; returns these runs.

        Only their predictions are read.
        """
        keys, present = self._keys(spark), set(tables.runs(spark, self.path))
        missing = [run for run, key in keys.items() if key not in present]
        patients = files.read_patients(spark, self.patients)
        for run in missing:
            predictions = files.read_predictions(spark, self.predictions, [run])
            sums = prediction_sums(patients, predictions, self.limits)
            tables.put_run(sums.select(SCHEMA.fieldNames()), self.path, keys[run])
        for key in present - set(keys.values()):
            tables.drop_run(spark, self.path, key)
        return missing

    def read(self, spark: SparkSession) -> DataFrame:
        """The sums of all runs; an error if a run's are missing."""
        keys = set(self._keys(spark).values())
        if missing := keys - set(tables.runs(spark, self.path)):
            raise LookupError(f"{len(missing)} runs are not summed up yet, call update first")
        return added(tables.read_runs(spark, self.path, SCHEMA, sorted(keys)))


# --- views of sums, with the columns of the views of the same name -------


def _known(sums: DataFrame) -> DataFrame:
    return sums.where("known")


def model_performance(sums: DataFrame) -> DataFrame:
    return sums.groupBy("model_name").agg(
        total().alias("total_predictions"),
        sum_where(F.col("prediction") == 1).alias("positive_predictions"),
        sum_where(F.col("prediction") == 0).alias("negative_predictions"),
        mean_score().alias("avg_probability"),
        F.min("score_min").alias("min_probability"),
        F.max("score_max").alias("max_probability"),
    )


def risk_score_distribution(sums: DataFrame) -> DataFrame:
    return sums.groupBy("model_name", "risk_category").agg(total().alias("patient_count"))


def _accuracy() -> Column:
    return share_of_rows(F.col("prediction") == F.col("target"))


def model_trends(sums: DataFrame, grain: str = "day") -> DataFrame:
    start = period_start(F.col("day"), grain).alias("prediction_date")
    return _known(sums).groupBy(start, "model_name").agg(
        total().alias("total_predictions"),
        _accuracy().alias("accuracy"),
        mean_score().alias("avg_risk_score"),
    )


def demographic_risk(sums: DataFrame) -> DataFrame:
    case = F.col("target") == 1
    return _known(sums).groupBy("age_group", "sex").agg(
        total().alias("total_patients"),
        sum_where(case).alias("heart_disease_cases"),
        share_of_rows(case).alias("heart_disease_rate"),
        mean_score().alias("avg_risk_score"),
        F.min("score_min").alias("min_risk_score"),
        F.max("score_max").alias("max_risk_score"),
    )


def prediction_confidence(sums: DataFrame) -> DataFrame:
    return _known(sums).groupBy("model_name", "confidence_level").agg(
        total().alias("prediction_count"), _accuracy().alias("accuracy_rate")
    )


def accuracy_by_model(sums: DataFrame) -> DataFrame:
    return _known(sums).groupBy("model_name").agg(
        total().alias("total_predictions"), _accuracy().alias("accuracy")
    )


def correctness_by_category(sums: DataFrame) -> DataFrame:
    label = correctness(F.col("prediction"), F.col("target")).alias("prediction_accuracy")
    return _known(sums).groupBy(label, "risk_category").agg(total().alias("count"))


def age_distribution(sums: DataFrame) -> DataFrame:
    case = F.col("target") == 1
    return _known(sums).groupBy("age_group").agg(
        total().alias("total_patients"),
        sum_where(case).alias("heart_disease_cases"),
        share_of_rows(case).alias("heart_disease_rate"),
    )


def sex_by_category(sums: DataFrame) -> DataFrame:
    return _known(sums).groupBy("sex", "risk_category").agg(total().alias("count"))


def score_histogram(sums: DataFrame, bins: int = Limits.bins) -> DataFrame:
    counted = _known(sums).where("bin is not null").groupBy("bin").agg(total().alias("count"))
    return counted.select("bin", (F.col("bin") / bins).alias("bin_start"), "count")


def score_by_category(sums: DataFrame) -> DataFrame:
    return _known(sums).groupBy("risk_category").agg(
        total().alias("count"), mean_score().alias("avg_risk_score")
    )


def risk_factor_counts(sums: DataFrame, older_groups: Sequence[str] = OLDER_GROUPS) -> DataFrame:
    factors = risk_factors(F.col("age_group"), F.col("exang"), F.col("above"), older_groups)
    return _known(sums).groupBy(factors.alias("risk_factors")).agg(total().alias("count"))
