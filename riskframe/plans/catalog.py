"""All views as named temporary views, for use from SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riskframe.functions.labels import OLDER_GROUPS, RISK_FACTOR_CUTOFF, RISK_THRESHOLDS
from riskframe.plans import sums, views


def register_views(
    spark: SparkSession,
    patients: DataFrame,
    predictions: DataFrame,
    model_metrics: DataFrame,
    thresholds: Sequence[float] = RISK_THRESHOLDS,
    older_groups: Sequence[str] = OLDER_GROUPS,
    cutoff: float = RISK_FACTOR_CUTOFF,
    kept_sums: DataFrame | None = None,
) -> list[str]:
    """Create or replace the views, and return their names. No job runs.

    Aggregated views are read from ``kept_sums`` if given, instead of from all
    predictions; those are sums for the same thresholds.

    The thresholds hold for every view that sorts scores into risk categories,
    the older groups and the cutoff for risk factors.
    """
    both = patients, predictions
    named = {
        "model_training_data": views.model_training_data(patients),
        "model_performance": views.model_performance(predictions),
        "feature_importance": views.feature_importance(model_metrics),
        "patient_risk_analysis": views.patient_risk_analysis(*both),
        "risk_score_distribution": views.risk_score_distribution(predictions, thresholds),
        "model_comparison": views.model_comparison(predictions),
        "patient_demographics": views.patient_demographics(patients),
        "feature_correlations": views.feature_correlations(patients),
        "tableau_model_trends": views.model_trends(*both),
        "tableau_patient_profiles": views.patient_profiles(*both, thresholds),
        "tableau_demographic_risk": views.demographic_risk(*both),
        "tableau_prediction_confidence": views.prediction_confidence(*both),
        "tableau_risk_assessment": views.risk_assessment(
            *both, thresholds, older_groups, cutoff
        ),
    }
    if kept_sums is not None:
        named |= {
            "model_performance": sums.model_performance(kept_sums),
            "risk_score_distribution": sums.risk_score_distribution(kept_sums),
            "tableau_model_trends": sums.model_trends(kept_sums),
            "tableau_demographic_risk": sums.demographic_risk(kept_sums),
            "tableau_prediction_confidence": sums.prediction_confidence(kept_sums),
        }
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return list(named)
