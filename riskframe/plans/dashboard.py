"""The dashboard's aggregates and filters.

Each is computed from per-patient sums rather than from the row-level view it
is drawn from; the results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import correctness, risk_category, risk_factors
from riskframe.functions.labels import OLDER_GROUPS, RISK_FACTOR_CUTOFF, RISK_THRESHOLDS
from riskframe.plans.views import (
    demographic_risk,
    feature_importance,
    mean_score,
    patient_profiles,
    risk_assessment,
    scores_per_patient,
    share_of_rows,
    sum_where,
    total,
    with_patients,
)

BIN_WIDTH = 0.05


def _category(thresholds: Sequence[float]) -> Column:
    return risk_category(F.col("probability"), thresholds).alias("risk_category")


def accuracy_by_model(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    """Accuracy over all predictions, that is daily accuracies weighted by count."""
    sums = scores_per_patient(predictions, "model_name", "prediction")
    return (
        with_patients(sums, patients, "target")
        .groupBy("model_name")
        .agg(
            total().alias("total_predictions"),
            share_of_rows(F.col("prediction") == F.col("target")).alias("accuracy"),
        )
    )


def correctness_by_category(
    patients: DataFrame, predictions: DataFrame, thresholds: Sequence[float] = RISK_THRESHOLDS
) -> DataFrame:
    sums = scores_per_patient(predictions, _category(thresholds), "prediction")
    label = correctness(F.col("prediction"), F.col("target")).alias("prediction_accuracy")
    return (
        with_patients(sums, patients, "target")
        .groupBy(label, "risk_category")
        .agg(total().alias("count"))
    )


def age_distribution(patients: DataFrame, predictions: DataFrame) -> DataFrame:
    case = F.col("target") == 1
    return (
        with_patients(scores_per_patient(predictions), patients, "age_group", "target")
        .groupBy("age_group")
        .agg(
            total().alias("total_patients"),
            sum_where(case).alias("heart_disease_cases"),
            share_of_rows(case).alias("heart_disease_rate"),
        )
    )


def sex_by_category(
    patients: DataFrame, predictions: DataFrame, thresholds: Sequence[float] = RISK_THRESHOLDS
) -> DataFrame:
    sums = scores_per_patient(predictions, _category(thresholds))
    return (
        with_patients(sums, patients, "sex")
        .groupBy("sex", "risk_category")
        .agg(total().alias("count"))
    )


def score_histogram(
    patients: DataFrame, predictions: DataFrame, width: float = BIN_WIDTH
) -> DataFrame:
    """Counts per bin ``[bin_start, bin_start + width)``; the last one ends at 1 and includes it.

    If 1 is no multiple of ``width``, the last bin is narrower.
    """
    if not 0 < width <= 1:
        raise ValueError("width must lie in (0, 1]")
    # A width that divides 1 up to rounding makes a whole number of equal bins.
    whole = abs(1 / width - round(1 / width)) < 1e-9
    bins = round(1 / width) if whole else math.ceil(1 / width)
    scaled = F.col("probability") * bins if whole else F.col("probability") / width
    start = F.col("bin") / bins if whole else F.col("bin") * width
    place = F.least(F.floor(scaled), F.lit(bins - 1)).alias("bin")
    sums = scores_per_patient(predictions.where(F.col("probability").isNotNull()), place)
    return (
        with_patients(sums, patients)
        .groupBy("bin")
        .agg(total().alias("count"))
        .select("bin", start.alias("bin_start"), "count")
    )


def feature_ranking(model_metrics: DataFrame) -> DataFrame:
    return feature_importance(model_metrics)


def score_by_category(
    patients: DataFrame, predictions: DataFrame, thresholds: Sequence[float] = RISK_THRESHOLDS
) -> DataFrame:
    sums = scores_per_patient(predictions, _category(thresholds))
    return (
        with_patients(sums, patients)
        .groupBy("risk_category")
        .agg(total().alias("count"), mean_score().alias("avg_risk_score"))
    )


def risk_factor_counts(
    patients: DataFrame,
    predictions: DataFrame,
    older_groups: Sequence[str] = OLDER_GROUPS,
    cutoff: float = RISK_FACTOR_CUTOFF,
) -> DataFrame:
    sums = scores_per_patient(predictions, (F.col("probability") > cutoff).alias("above"))
    factors = risk_factors(F.col("age_group"), F.col("exang"), F.col("above"), older_groups)
    return (
        with_patients(sums, patients, "age_group", "exang")
        .groupBy(factors.alias("risk_factors"))
        .agg(total().alias("count"))
    )


def _in(column: Column, values: Sequence | None) -> Column:
    return F.lit(True) if values is None else column.isin(*values)


def _between(column: Column, dates: tuple[datetime | None, datetime | None]) -> Column:
    """Includes the start and excludes the end; a missing end is open.

    The limits have the column's type: they reach the scan as they are.
    """
    start, end = (None if x is None else F.lit(x).cast("timestamp_ntz") for x in dates)
    after = F.lit(True) if start is None else column >= start
    return after if end is None else after & (column < end)


def filter_inputs(
    patients: DataFrame,
    predictions: DataFrame,
    dates: tuple[datetime | None, datetime | None] = (None, None),
    models: Sequence[str] | None = None,
    risk_categories: Sequence[str] | None = None,
    age_groups: Sequence[str] | None = None,
    sexes: Sequence | None = None,
    thresholds: Sequence[float] = RISK_THRESHOLDS,
) -> tuple[DataFrame, DataFrame]:
    """The dashboard's filters, applied to the tables below a view.

    Age group and sex limit the patients, everything else the predictions; all
    of it reaches the scan. Right for every view whose rows depend on the rows
    kept alone. The age-adjusted risk is set against a mean over all rows, so
    that view is filtered above it, by ``filtered_assessment``.
    """
    predictions = predictions.where(
        _between(F.col("created_at"), dates)
        & _in(F.col("model_name"), models)
        & _in(_category(thresholds), risk_categories)
    )
    patients = patients.where(_in(F.col("age_group"), age_groups) & _in(F.col("sex"), sexes))
    return patients, predictions


def filtered_profiles(patients: DataFrame, predictions: DataFrame, **filters) -> DataFrame:
    return patient_profiles(*filter_inputs(patients, predictions, **filters))


def filtered_demographics(patients: DataFrame, predictions: DataFrame, **filters) -> DataFrame:
    return demographic_risk(*filter_inputs(patients, predictions, **filters))


def filtered_assessment(
    patients: DataFrame,
    predictions: DataFrame,
    dates: tuple[datetime | None, datetime | None] = (None, None),
    models: Sequence[str] | None = None,
    risk_categories: Sequence[str] | None = None,
    age_groups: Sequence[str] | None = None,
    sexes: Sequence | None = None,
    thresholds: Sequence[float] = RISK_THRESHOLDS,
) -> DataFrame:
    """The risk view's rows that the filters keep, with means over all of its rows.

    ``dates`` limit the view's own ``created_at``.
    """
    assessed = risk_assessment(patients, predictions)
    return assessed.where(
        _between(F.col("created_at"), dates)
        & _in(F.col("model_name"), models)
        & _in(risk_category(F.col("risk_score"), thresholds), risk_categories)
        & _in(F.col("age_group"), age_groups)
        & _in(F.col("sex"), sexes)
    )
